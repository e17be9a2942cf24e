import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as s

from weavegrid.llm import chat_format as cf
from weavegrid.llm import queries

FILES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXT = s.lists(s.sampled_from(["<|im_end|>", "<|im_start|>", "<|im_sep|>", "<|endoftext|>", "<", "\\", "|", "<\\|", "\n", " ", "é", "日本", "😀", "a", "ok ", "  x"]), max_size=12).map("".join)
SCHEMA = "conv_id long, turn long, role string, text string, offsets string"


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_escaping_is_reversible(text):
    assert cf.unescape(cf.escape(text)) == text
    assert "<|" not in cf.escape(text)


@settings(max_examples=200, deadline=None)
@given(s.lists(s.tuples(s.sampled_from(["user", "assistant", "system", "<|im_sep|>", ""]), TEXT), max_size=6))
def test_masks_say_the_trained_texts(turns):
    text, spans = cf.render(turns)
    assert cf.parse(text) == turns
    ids, offsets = cf.encoder(*FILES)(text)
    assert cf.encoder(*FILES).bpe.decode(ids.tolist()) == text
    mask = cf.mask_tokens(offsets, spans)
    assert cf.masked_text(text, offsets, mask) == "".join(x for r, x in turns if r == "assistant")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "hello <|im_end|>", "x"), (1, 0, "user", None, "x"), (2, 0, None, "a", "x"), (None, 3, "assistant", "ü" * 60_000, "x"), (3, 0, "assistant", "b", "x"), (3, 0, "assistant", "a", "x"), (3, 0, "assistant", "a", "x")]
    out = cf.formatted(spark.createDataFrame(rows, SCHEMA), *FILES)
    got = {r["conv_id"]: r for r in cf.read_back(out).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\nhello <|im_end|>\n") and got[1]["loss_sha256"] == sha("hello <|im_end|>")
    assert got[2]["loss_chars"] == 0 and got[2]["loss_sha256"] == sha("")
    assert got[None]["loss_chars"] == 60_000
    assert got[3]["n_turns"] == 3 and got[3]["loss_sha256"] == sha("aab")
    assert cf.read_back(cf.formatted(spark.createDataFrame([], SCHEMA), *FILES)).count() == 0


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_offsets_are_those_of_the_tokenizers_library(text):
    from tokenizers import Tokenizer, processors

    if not _held:
        _held.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
        _held[0].post_processor = processors.ByteLevel(trim_offsets=False)
        _held[0].add_special_tokens([cf.START, cf.SEPARATOR, cf.STOP])
    text = cf.render([("user", text), ("assistant", text)])[0]
    wanted = _held[0].encode(text, add_special_tokens=False)
    ids, offsets = cf.encoder(*FILES)(text)
    assert ids.tolist() == wanted.ids and [tuple(o) for o in offsets.tolist()] == wanted.offsets


_held = []


def test_very_long_blanks_keep_offsets():
    encode = cf.encoder(*queries.byte_bpe()[1:])
    for end in ("", "x", cf.STOP):
        text = cf.START + "a" + "\n" * 1_200_000 + end
        ids, offsets = encode(text)
        assert encode.bpe.decode(ids.tolist()) == text
        assert offsets[0, 0] == 0 and offsets[-1, 1] == len(text) and (offsets[1:, 0] <= offsets[:-1, 1]).all()
    short = "a" + " " * 11_000 + "b"
    assert encode(short)[0].tolist() == encode.bpe.encode(short)


def test_rows_without_a_conversation_stand_alone(spark):
    rows = spark.createDataFrame([(None, 0, "user", "a", 1), (None, 0, "user", "a", 1), (3, 1, "assistant", "b", 2), (3, 0, None, None, 3)], "conv_id long, turn long, role string, text string, turns int")
    out = sorted((r["conv_id"] or 0, [(t["role"], t["text"]) for t in r["turns"]]) for r in cf.conversations(rows).collect())
    assert out == [(0, [("user", "a")]), (0, [("user", "a")]), (3, [("", ""), ("assistant", "b")])]

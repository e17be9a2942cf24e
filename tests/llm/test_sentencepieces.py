import functools
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as s

from weavegrid.llm import sentencepieces as sp
from weavegrid.llm.queries import piece_model

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain(model, text):
    """Viterbi over all substrings, with a dictionary."""
    pieces = {p: (i, x) for i, (p, x, kind) in enumerate(sp.load_pieces(PATH)) if kind in (sp.NORMAL, sp.USER_DEFINED)}
    t = sp.MARK + text.replace(" ", sp.MARK) if text else ""
    best = [(0.0, [])] + [None] * len(t)
    for a in range(len(t)):
        single = False
        for b in range(a + 1, min(len(t), a + 50) + 1):
            if t[a:b] in pieces:
                i, x = pieces[t[a:b]]
                single |= b == a + 1
                if best[b] is None or best[a][0] + x > best[b][0]:
                    best[b] = (best[a][0] + x, best[a][1] + [i])
        if not single and (best[a + 1] is None or best[a][0] + model.unknown_score > best[a + 1][0]):
            best[a + 1] = (best[a][0] + model.unknown_score, best[a][1] + [model.byte_ids[c] for c in t[a].encode()])
    return best[-1][1]


SAMPLES = ["", " ", "The quick brown fox", "  two  spaces ", "tab\tand\nline", "日本語 text", "😀 emoji 👍🏽", "naïve façade", "x" * 400, "ünïcödé" * 30, "a▁b"]


def test_samples():
    model = piece_model(PATH)
    for t in SAMPLES:
        assert model.encode(t) == plain(model, t), t
        assert model.decode(model.encode(t)) == t.replace(sp.MARK, " ")


@settings(max_examples=150, deadline=None)
@given(s.lists(s.sampled_from(["the", "ing", " ", "  ", "é", "\n", "日", "😀", "qz", "Tion", "123", "\x00"]), max_size=14).map("".join))
def test_any(text):
    model = piece_model(PATH)
    assert model.encode(text) == plain(model, text)
    assert model.decode(model.encode(text)) == text


def as_unigram(data):
    """The model file with its kind set to unigram, for the public library."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out, i = b"", 0
    while i < len(data):
        start = i
        n = shift = 0
        i += 1
        while True:
            n |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                break
        body = data[i : i + n]
        i += n
        if data[start] >> 3 == 2:
            body = body.replace(b"\x18\x02 \x80", b"\x18\x01 \x80", 1)  # model_type, before vocab_size
        out += bytes([data[start]]) + varint(len(body)) + body
    return out


@functools.cache
def library():
    import sentencepiece

    with open(PATH, "rb") as f:
        return sentencepiece.SentencePieceProcessor(model_proto=as_unigram(f.read()))


def test_words_as_the_library_segments_them(spark, sf):
    """Word by word, by the library's lattice: over whole texts it adds scores in single precision, and its shortcut for one best path isn't exact."""
    words = sorted({w for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for w in r["text"].split()})
    random.Random(1).shuffle(words)
    model = piece_model(PATH)
    for w in words[:4000]:
        assert model.encode(w) == library().nbest_encode_as_ids(w, 2)[0], w


def test_table(spark):
    long = "word " * 40_000
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, long, "x"), (None, "a b", "x"), (4, "a▁b", "x"), (4, "a▁b", "x")], "doc_id long, text string, ids string")
    model = piece_model(PATH)
    rows = sp.round_trips(docs, model).collect()
    assert len(rows) == 6 and all(r["round_trip"] for r in rows)
    assert {r["doc_id"]: r["n_ids"] for r in rows}[1] == 0
    coded = sp.encoded(docs, model)
    texts = sorted((r["text"] for r in sp.decoded(coded, model).collect()))
    assert texts == sorted(["", "", long, "a b", "a b", "a b"])
    assert sp.round_trips(docs.where("false"), model).count() == 0


def test_vocabulary_that_needs_whole_texts():
    pieces = [("<unk>", 0.0, sp.UNKNOWN), ("▁a", -1.0, 1), ("▁b", -1.0, 1), ("▁a▁b", -1.5, 1), ("c", -1.0, 1)]
    model = sp.Unigram(pieces)
    assert not model.by_word
    assert model.encode("a b") == [3] and model.encode("ac b") == [1, 4, 2] and model.encode("z") == [0, 0]


def test_cache_is_bounded_by_bytes(monkeypatch):
    from weavegrid.llm.queries import _tokenizer

    model = piece_model(_tokenizer("piece_bpe_32k.model"))
    texts = [" ".join(f"w{i}x{j}" for j in range(40)) + " " + "long" * i for i in range(60)]
    wanted = model.encode_bytes(texts)
    monkeypatch.setattr(sp, "CACHED_BYTES", 20_000)
    model.cache, model.cached_bytes = {}, 0
    assert [x for t in texts for x in model.encode_bytes([t])] == wanted
    assert model.cached_bytes <= 20_000 + 40 * 400 and all(len(w) <= sp.CACHED_WORD for w in model.cache)

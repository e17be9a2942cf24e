"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one text of marked turns and encoded once, with
offsets. Turn spans and token spans are both sorted, so a binary search gives
the tokens of every assistant text, which form the loss mask.

Template, for each turn: ``<|im_start|>`` role ``<|im_sep|>`` text
``<|im_end|>`` newline. The three marks are added to the tokenizer as special
tokens: each is one token and no other token crosses it, so masks are exact.

Escaping: in roles and texts every ``<``, backslashes, ``|`` gets one more
backslash, so ``<|`` occurs only in marks; unescaping takes one away.

Defined cases: null roles and texts count as empty; rows that share a turn
are ordered by role, then text; repeated rows are turns of their own; a row
without a conv_id is a conversation of its own, so no task collects them all;
very long texts are encoded whole; columns besides the four are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weavegrid.llm.common import ship, without_long_blanks

START, SEPARATOR, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
#: Conversations that a worker holds as Python objects at once.
AT_ONCE = 32

_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the (start, end) of each trained text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"{START}{escape(role)}{SEPARATOR}", escape(text), f"{STOP}\n"
        if role == TRAINED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted text holds."""
    turns = []
    for piece in formatted.split(START)[1:]:
        head, _, rest = piece.partition(SEPARATOR)
        turns.append((unescape(head), unescape(rest[: rest.rindex(STOP)])))
    return turns


def mask_tokens(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in one of the sorted spans; offsets: n rows of start and end."""
    mask = np.zeros(len(offsets), bool)
    if len(offsets) and spans:
        first = np.searchsorted(offsets[:, 0], [a for a, _ in spans], "left")
        last = np.searchsorted(offsets[:, 1], [b for _, b in spans], "right")
        for a, b in zip(first, last):
            mask[a:b] = True
    return mask


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """What the masked tokens say, unescaped, run by run. Several tokens may share one character."""
    at = np.flatnonzero(mask)
    if not at.size:
        return ""
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    return "".join(unescape(formatted[offsets[r[0], 0] : offsets[r[-1], 1]]) for r in runs)


class Encoder:
    """A byte-level BPE with the three marks as special tokens, and the place of each token in the text."""

    def __init__(self, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        marks = {m: max(ranks.values()) + 2 + i for i, m in enumerate((START, SEPARATOR, STOP))}
        self.bpe = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens=marks)
        self.sizes = np.zeros(max(marks.values()) + 1, np.int64)
        for token, i in [*ranks.items(), *((m.encode(), i) for m, i in marks.items())]:
            self.sizes[i] = len(token)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and rows of start and end in code points. Tokens that share a character's bytes have the same place."""
        if len(text) < 10_000:
            ids = self.bpe.encode(text, allowed_special="all")
        else:
            marks = (START, SEPARATOR, STOP)
            ids = [i for part, is_piece in without_long_blanks(text, marks) for i in (self.bpe._encode_single_piece(part) if is_piece else self.bpe.encode(part, allowed_special="all"))]
        ids = np.array(ids, np.int32)
        ends = np.cumsum(self.sizes[ids])
        character = np.cumsum(np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80) - 1
        return ids, np.column_stack([character[ends - self.sizes[ids]], character[ends - 1] + 1]).astype(np.int32).reshape(-1, 2)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One for each worker process."""
    if (ranks_path, pattern) not in _encoders:
        _encoders[ranks_path, pattern] = Encoder(ranks_path, pattern)
    return _encoders[ranks_path, pattern]


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns: the rows of each conversation by turn."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    known = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return known.union(rows.where("conv_id is null").select("conv_id", F.array("turn").alias("turns")))


def formatted(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """conv_id, formatted, ids, offsets (start and end of each token in turn, flat), loss_mask."""
    ship(rows.sparkSession)

    def run(batches):
        encode = encoder(ranks_path, pattern)
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                texts, spans = zip(*[render([(x["role"], x["text"]) for x in c]) for c in part.column("turns").to_pylist()])
                ids, offsets = zip(*map(encode, texts))
                masks = [mask_tokens(o, s) for o, s in zip(offsets, spans)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("conv_id"),
                        pa.array(texts),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array([o.ravel() for o in offsets], pa.list_(pa.int32())),
                        pa.array(masks, pa.list_(pa.bool_())),
                    ],
                    names=["conv_id", "formatted", "ids", "offsets", "loss_mask"],
                )

    return conversations(rows).mapInArrow(run, "conv_id long, formatted string, ids array<int>, offsets array<int>, loss_mask array<boolean>")


def read_back(output: DataFrame) -> DataFrame:
    """Digests of the turns and the masked texts that ``formatted`` put out."""
    ship(output.sparkSession)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part, rows = batch.slice(a, AT_ONCE), []
                offsets, masks = part.column("offsets"), part.column("loss_mask")
                for i, (c, text) in enumerate(zip(part.column("conv_id").to_pylist(), part.column("formatted").to_pylist())):
                    turns = parse(text)
                    at, mask = offsets[i].values.to_numpy().reshape(-1, 2), masks[i].values.to_numpy(zero_copy_only=False)
                    loss = masked_text(text, at, mask)
                    rows.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text), len(mask)))
                names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    return output.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")

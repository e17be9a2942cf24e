"""Best-fit packing of tokenised documents into sequences: best-two-fit.

Bins are filled greedily: the longest remaining piece opens a bin and the
longest piece that fits the gap follows, again and again. Then the bin's
smallest piece is taken out when two unpacked pieces fit the widened gap more
tightly.

Pieces of one length are alike, so a plan needs only the histogram of lengths
(at most ``capacity`` rows, whatever the corpus). ``plan`` repeats each bin as
often as the counts allow at one go, which ends a length each time; a plan
therefore has a few thousand rows at most. The pieces of each length are then
numbered within Spark and matched with the places that the plan gives them.

Defined cases: a null text counts as empty (one piece, the end mark); rows
that repeat a doc_id, or repeat as a whole, are packed as documents of their
own; very long texts are encoded whole, very long runs of white space as the
single pieces that the tokenizer's pattern makes of them.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weavegrid.llm.common import ship, slices, stored, text_or_empty, without_long_blanks

CAPACITY = 1024
END = 2

#: Characters on which both libraries' Unicode tables agree for certain.
_USUAL = re.compile("[\t\n\r\x20-\x7e¡-ɏͰ-ͳΆ-ώА-я‐-‧€]*")
_MARK = "<|endoftext|>"


class Encoder:
    """Ids of the 50k byte-level BPE.

    The same vocabulary comes as a file for a faster library; texts of usual
    characters go through that one, all others and those with the special
    token through ``tokenizers`` itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer, pre_tokenizers

        self.slow = Tokenizer.from_file(json_path)
        # without the pattern: all of a text is one piece
        self.piece = Tokenizer.from_file(json_path)
        self.piece.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if len(text) < 10_000:
            return self._part(text)
        return [i for part, is_piece in without_long_blanks(text, (_MARK,)) for i in (self.piece.encode(part, add_special_tokens=False).ids if is_piece else self._part(part))]

    def _part(self, text: str) -> list[int]:
        if self.fast and _MARK not in text and _USUAL.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


_encoders: dict[tuple, Encoder] = {}


def encoder(*paths) -> Encoder:
    """One for each worker process."""
    if paths not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[paths] = Encoder(*paths)
    return _encoders[paths]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def tokenized(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece."""
    ship(docs.sparkSession)
    schema = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(schema + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches):
        encode = encoder(json_path, ranks_path, pattern)
        for part in slices(batches):
            rows = []
            for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = np.array([*encode(t), END], "<u4")
                for i, (start, n) in enumerate(cut(len(ids), capacity)):
                    own = ids[start : start + n]
                    rows.append((d, i, start, n, zlib.crc32(own.tobytes())) + ((own.astype(np.int32),) if with_ids else ()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, ddl)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins of lengths, longest first, each with the number of times it is used."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while (open_with := np.flatnonzero(left)).size:
        used = np.zeros_like(left)
        gap, size, items = capacity, int(open_with[-1]), []
        while size:
            # as many of this length as fit; the longest that fits is then shorter
            n = int(min(gap // size, left[size] - used[size]))
            used[size] += n
            items += [size] * n
            gap -= n * size
            fits = np.flatnonzero((left - used)[: gap + 1])
            size = int(fits[-1]) if fits.size else 0
        if gap and len(items) > 1:
            items, used = _two_for_one(items, used, left, gap)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        out.append((items, times))
    return out


def _two_for_one(items, used, left, gap):
    """Replace the smallest piece by the two unpacked ones that fit its widened gap best, if that is tighter."""
    small = items[-1]
    room = small + gap
    free = left - used
    free[small] += 1  # it is unpacked again, and one of the two may be as long
    x = np.flatnonzero(free[: room + 1])
    x = x[x > 0]
    if not x.size:
        return items, used
    # for each x the longest partner that fits: the highest free length up to room - x
    upto = np.zeros(room + 1, np.int64)
    upto[x] = x
    upto = np.maximum.accumulate(upto)
    y = upto[room - x]
    alone = (y == x) & (free[x] < 2)
    y[alone] = upto[np.maximum(x[alone] - 1, 0)]
    total = np.where(y > 0, x + y, 0)
    best = int(total.argmax())
    if total[best] <= small:
        return items, used
    used = used.copy()
    used[small] -= 1
    pair = sorted((int(x[best]), int(y[best])), reverse=True)
    for p in pair:
        used[p] += 1
    return sorted(items[:-1] + pair, reverse=True), used


def places(bins: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each run of equal places: length, first number among pieces of that length, count, first sequence, offset, sequences apart.

    The k-th piece of the run lies in sequence ``first + k`` at ``offset``.
    """
    out, seen, sequence = [], {}, 0
    for items, times in bins:
        offset = 0
        for length in items:
            out.append((length, seen.get(length, 0), times, sequence, offset))
            seen[length] = seen.get(length, 0) + times
            offset += length
        sequence += times
    return out


#: Pieces of one length are numbered in groups of about GROUP rows, in up to GROUPS groups, or of a million rows beyond that.
GROUP, GROUPS, LARGE_GROUP = 500, 256, 1_000_000


def numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` (with n_groups for their length, and an id ``row`` of each) with ``number``, counting from 0 within each length.

    No length is numbered in one task: its pieces are dealt over groups by
    ``row``, each numbered by itself, and the groups' sizes give each its first
    number.
    """
    rows = pieces.withColumn("part", F.pmod(F.xxhash64("row"), F.col("n_groups")))
    counts = rows.groupBy("length", "part").count()
    first = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # at most capacity * GROUPS narrow rows, and one more for every million pieces
    starts = F.broadcast(counts.select("length", "part", F.coalesce(first, F.lit(0)).alias("first")))
    order = Window.partitionBy("length", "part").orderBy("row")
    rows = rows.withColumn("rank", F.row_number().over(order)).join(starts, ["length", "part"])
    return rows.withColumn("number", F.col("first") + F.col("rank") - 1).drop("part", "rank", "first", "n_groups", "row")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32 ...) with sequence_id and offset."""
    spark = pieces.sparkSession
    names = pieces.columns
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    by_length: dict[int, list] = {}
    for length, *run in places(plan(counts, capacity)):
        by_length.setdefault(length, []).append(tuple(run))
    checked_runs(by_length)
    groups = {n: max(min(-(-c // GROUP), GROUPS), -(-c // LARGE_GROUP)) for n, c in counts.items()}
    table = spark.createDataFrame(
        [(n, groups[n], runs) for n, runs in by_length.items()],
        "length long, n_groups long, runs array<struct<number:long,times:long,sequence:long,offset:long>>",
    )
    rows = numbered(pieces.join(F.broadcast(table.drop("runs")), "length"))
    rows = rows.join(F.broadcast(table.drop("n_groups")), "length").withColumn("run", _run_of(F.col("runs"), F.col("number")))
    return rows.select(*names, (F.col("run.sequence") + F.col("number") - F.col("run.number")).alias("sequence_id"), F.col("run.offset").alias("offset"))


#: Halving steps by which a run is looked up.
RUN_STEPS = 14


def checked_runs(by_length: dict[int, list]) -> None:
    """An error where a length has more runs than can be looked up; a plan has fewer bins than lengths and their square roots allow, far below that."""
    most = max(map(len, by_length.values()), default=0)
    if most >= 1 << RUN_STEPS:
        raise ValueError(f"{most} runs of one length, but only {(1 << RUN_STEPS) - 1} can be looked up")


def _run_of(runs, number):
    """The last run that starts at or before ``number``, by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in range(RUN_STEPS - 1, -1, -1)])
    at = F.aggregate(
        steps,
        F.lit(1),
        lambda acc, step: acc + F.when((acc + step <= F.size(runs)) & (F.get(runs, acc + step - 1)["number"] <= number), step).otherwise(F.lit(0)),
    )
    return F.get(runs, at - 1)

"""Line dedup by a log-template tree.

Lines are parsed like log messages (after Drain): a tree of fixed depth leads
by token count, then by the leading tokens, where tokens with digits count as
variable; a line with such tokens in more than half of its places recurs only
as it stands, in a leaf of its own. In a leaf two lines share a template if
they differ in a quarter of their places at most (``AGREEMENT``) and equal each
other in half of them, variable ones not counted; the places that differ are
the template's variable fields. So lines that vary in numbers, names or a few
words share one. A line whose template ``MIN_DOCS`` documents or more hold
recurs: it stays in the one with the smallest doc_id and is dropped from all
others. A line of ``LONG_TOKENS`` or more that stands as it is in two documents
recurs too.

What agrees with what is a matter of two lines alone, so neither their order
nor the size of a leaf nor how it is dealt over tasks changes a result. Lines
of a large leaf find each other by equi-joins: as at most a quarter of the places
differ, of so many groups of places and one more at least one is equal, so
lines meet in the buckets of their groups' tokens. In a large bucket lines are
compared with the ``PIVOTS`` of the smallest documents first, which settles
those of frequent templates; for what is left it is split again by its other
places. A bucket whose lines can't differ in too many any more is a template as
a whole. Pairs are compared only in buckets of at most ``BUCKET`` ** 2 of them.
Lines are known by 64-bit hashes and tokens by 16-bit ones, so a place may be
taken for equal by one in 65,536. All that is known of a line's documents, until
the end, is the smallest one and ``MIN_DOCS`` in all.

Defined cases: a null text counts as empty; blank lines always stay, and so do
those of fewer than ``min_tokens`` tokens (``MIN_TOKENS`` unless the caller
says otherwise; op4 and the pipeline parse lines of one token too); very long
texts are parsed whole; rows that repeat a doc_id count as one document; rows
without a doc_id pass unchanged and aren't counted; other columns stay, but for
n_lines and n_dropped, or what the caller names the counts; no rows give no
rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weavegrid.llm.common import discard, free_name, ship, slices, stored

MIN_DOCS = 3
MIN_TOKENS = 3
LONG_TOKENS = 20
LEADING = 3
AGREEMENT = 0.75
BUCKET, BUCKET_MOST = 1024, 1 << 16
PIVOTS = 64
VARIABLE = 0  # of 16-bit token hashes; others lie above

_DIGIT = re.compile(r"\d")


def _hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Lines:
    """The lines of some texts that count, as arrays: text and line number, leaf, line hash (and that of the exact tokens) and token hashes (flat, from start on)."""

    def __init__(self, texts: list[str], min_tokens: int = MIN_TOKENS):
        words: list[str] = []
        doc, number, size = [], [], []
        for i, t in enumerate(texts):
            for j, line in enumerate(t.split("\n")):
                w = line.split()
                if len(w) >= max(min_tokens, 1):
                    doc.append(i)
                    number.append(j)
                    size.append(len(w))
                    words += w
        self.doc, self.number, self.size = (np.array(x, np.int64) for x in (doc, number, size))
        h = _hashes(words)
        self.start = np.cumsum(self.size) - self.size
        if not len(h):
            self.tokens, self.leaf, self.hash, self.exact = np.zeros(0, np.uint16), *(np.zeros(0, np.int64) for _ in range(3))
            return
        joined = "\n".join(words)
        self.exact = self._line_hashes(h)
        few = np.zeros(len(self.size), bool)
        if _DIGIT.search(joined):
            h[np.fromiter((_DIGIT.search(w) is not None for w in words), bool, len(words))] = VARIABLE
            few = np.add.reduceat((h != VARIABLE).astype(np.int64), self.start) * 2 < self.size
        self.tokens = np.where(h == VARIABLE, 0, 1 + h % np.uint64(65535)).astype(np.uint16)
        # a line of mostly variable tokens says too little to stand for others: it is known by all its tokens
        self.hash = np.where(few, self.exact, self._line_hashes(h))
        leaf = self.size.astype(np.uint64)
        for k in range(LEADING):
            token = np.where(self.size > k, h[self.start + np.minimum(k, self.size - 1)], np.uint64(0))
            leaf = _scramble(leaf * np.uint64(0x9E3779B97F4A7C15) + token)
        self.leaf = np.where(few, _scramble(self.exact.view(np.uint64)), leaf).view(np.int64)

    def _line_hashes(self, h: np.ndarray) -> np.ndarray:
        place = _scramble(h + (np.arange(len(h)) - np.repeat(self.start, self.size)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return _scramble(np.add.reduceat(place, self.start)).view(np.int64)

    def vectors(self) -> list[bytes]:
        data = self.tokens.tobytes()
        return [data[2 * a : 2 * (a + n)] for a, n in zip(self.start.tolist(), self.size.tolist())]


def _parsed(min_tokens: int):
    def run(batches):
        for part in slices(batches):
            lines = Lines(part.column("text").to_pylist(), min_tokens)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(lines.doc)), pa.array(lines.leaf), pa.array(lines.hash), pa.array(lines.exact), pa.array(lines.vectors(), pa.binary())],
                names=["doc_id", "leaf", "line", "exact", "tokens"],
            )

    return run


def _may_differ(places: int) -> int:
    """In how many places two lines of so many tokens may differ."""
    return int(places * (1 - AGREEMENT))


def agreeing(vectors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which token vectors (rows, all of one length) share a template with which others."""
    (n, places), m = vectors.shape, len(others)
    out = np.zeros((n, m), bool)
    step = max(1, (1 << 22) // max(m * places, 1))
    for i in range(0, n, step):
        same = vectors[i : i + step, None, :] == others[None, :, :]
        fixed = (same & (others != VARIABLE)[None, :, :]).sum(axis=2)
        out[i : i + step] = (places - same.sum(axis=2) <= _may_differ(places)) & (2 * fixed >= places)
    return out


def _first_docs(vectors: np.ndarray, others: np.ndarray, docs: list[list[int]], min_docs: int) -> list[list[int]]:
    """For each vector the smallest documents (docs of the others, at least one each) of those that share its template."""
    doc, member = (np.array(x, np.int64) for x in zip(*sorted((d, i) for i, own in enumerate(docs) for d in own)))
    step = max(1, (1 << 22) // max(len(others), 1))
    found = []
    for i in range(0, len(vectors), step):
        for agree in agreeing(vectors[i : i + step], others):
            own = doc[agree[member]]
            found.append(own[np.diff(own, prepend=own[0] - 1) != 0][:min_docs].tolist() if len(own) else [])
    return found


def _vectors(tokens: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(tokens), np.uint16).reshape(len(tokens), -1)


def _groups_of(batches, *columns: str):
    """Rows sorted by whole-number columns, in batches, as one table for each run of equal values."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.column_stack([batch.column(c).to_numpy() for c in columns])
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            own = values[a].tolist()
            if kept and own != last:
                yield pa.Table.from_batches(kept)
                kept = []
            last = own
            kept.append(batch.slice(a, b - a))
    if kept:
        yield pa.Table.from_batches(kept)


_FOUND = "leaf long, line long, docs array<long>"
_BUCKETS = "bucket long, leaf long, line long, tokens binary, docs array<long>, left binary, whole boolean, asks boolean"


def _compared(min_docs: int):
    """Lines that ask, in buckets, to the smallest documents of the lines that share their template."""

    def run(batches):
        for t in _groups_of(batches, "bucket"):
            vectors, asks = _vectors(t.column("tokens").to_pylist()), np.flatnonzero(t.column("asks").to_numpy())
            found = _first_docs(vectors[asks], vectors, t.column("docs").to_pylist(), min_docs)
            rows = pa.array(asks)
            yield pa.RecordBatch.from_arrays([t.column(c).take(rows).combine_chunks() for c in ("leaf", "line")] + [pa.array(found, pa.list_(pa.int64()))], names=["leaf", "line", "docs"])

    return run


def _settled(min_docs: int):
    """Lines with the pivots of their bucket to the same lines, with the documents found; those with enough ask no more."""

    def run(batches):
        for t in _groups_of(batches, "bucket"):
            first = t.column("pivots")[0].as_py()
            found = _first_docs(_vectors(t.column("tokens").to_pylist()), _vectors([p["tokens"] for p in first]), [p["docs"] for p in first], min_docs)
            asks = t.column("asks").to_numpy() & np.array([len(f) < min_docs for f in found])
            own = [t.column(c).combine_chunks() for c in ("bucket", "leaf", "line", "tokens", "docs", "left", "whole")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(asks), pa.array(found, pa.list_(pa.int64()))], names=["bucket", "leaf", "line", "tokens", "docs", "left", "whole", "asks", "found"])

    return run


def _split(batches):
    """Lines of large buckets to smaller ones: by groups of the places that are left, one of which is equal in any two that agree.

    Where no more places are left than may differ, all lines of a bucket agree
    if they have enough equal places for it (whole); else they are split by
    single places, one of which must be equal and not variable.
    """
    for batch in batches:
        source, buckets, lefts, wholes = [], [], [], []
        for i, (bucket, tokens, left) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "tokens", "left")))):
            v, places = np.frombuffer(tokens, np.uint16), np.frombuffer(left, np.uint16)
            most = _may_differ(len(v))
            if len(places) > most:
                groups = np.array_split(places, most + 1)
            else:
                groups = [places[j : j + 1] for j in np.flatnonzero(v[places] != VARIABLE)]
            for j, group in enumerate(groups):
                rest = np.setdiff1d(places, group)
                fixed = np.ones(len(v), bool)
                fixed[rest] = False
                name = hashlib.blake2b(np.int64(bucket).tobytes() + group.tobytes() + v[group].tobytes(), digest_size=8)
                source.append(i)
                buckets.append(int.from_bytes(name.digest(), "little", signed=True))
                lefts.append(rest.astype(np.uint16).tobytes())
                wholes.append(len(rest) <= most and 2 * int((fixed & (v != VARIABLE)).sum()) >= len(v))
        rows = pa.array(source, pa.int64())
        kept = [batch.column(c).take(rows) for c in ("leaf", "line", "tokens", "docs", "asks")]
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), *kept[:4], pa.array(lefts, pa.binary()), pa.array(wholes, pa.bool_()), kept[4]], names=["bucket", "leaf", "line", "tokens", "docs", "left", "whole", "asks"])


def _smallest(docs: str, min_docs: int):
    return F.slice(F.array_sort(F.collect_set(docs)), 1, min_docs)


def _sizes(rows: DataFrame, bucket: int) -> DataFrame:
    """bucket, size, kind (whole, small or large) of the buckets in which a line asks for others."""
    counts = rows.groupBy("bucket").agg(F.count("*").alias("size"), F.count_if("asks").alias("asking"), F.max("whole").alias("is_whole")).where("size > 1 and asking > 0")
    is_small = (F.col("asking") * F.col("size") <= bucket * bucket) & (F.col("size") <= BUCKET_MOST)
    return stored(counts.select("bucket", "size", F.when(F.col("is_whole"), "whole").when(is_small, "small").otherwise("large").alias("kind")), "bucket-sizes")


def shared_templates(distinct: DataFrame, min_docs: int = MIN_DOCS, bucket: int | None = None, pivots: int | None = None) -> DataFrame:
    """leaf, line, docs: of every line the smallest document of the lines that share its template, itself included, and others of them up to ``min_docs``.

    distinct: leaf, line, tokens, docs (the smallest of the line itself).
    """
    bucket, pivots = bucket or BUCKET, pivots or PIVOTS

    def places(batches):
        for batch in batches:
            n = batch.num_rows
            left = [np.arange(min(LEADING, len(t) // 2), len(t) // 2, dtype=np.uint16).tobytes() for t in batch.column("tokens").to_pylist()]
            own = [batch.column(c) for c in ("leaf", "leaf", "line", "tokens", "docs")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(left, pa.binary()), pa.array(np.zeros(n, bool)), pa.array(np.ones(n, bool))], names=["bucket", "leaf", "line", "tokens", "docs", "left", "whole", "asks"])

    found = [distinct.select("leaf", "line", "docs")]
    rows = distinct.select("leaf", "line", "tokens", "docs").mapInArrow(places, _BUCKETS)
    spent = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        spent.append(stored(df, name))
        return spent[-1]

    of_kind = lambda rows, sizes, kind, *more: rows.join(sizes.where(F.col("kind") == kind).select("bucket", *more).hint("merge"), "bucket")
    while True:
        rows = keep(rows, "buckets")
        sizes = _sizes(rows, bucket)
        spent.append(sizes)
        # lines that all agree: the documents of all are those of each; no more than are needed leave a task
        whole = of_kind(rows, sizes, "whole")
        ranked = whole.select("bucket", F.explode("docs").alias("doc")).withColumn("r", F.dense_rank().over(Window.partitionBy("bucket").orderBy("doc"))).where(F.col("r") <= min_docs)
        of_bucket = ranked.groupBy("bucket").agg(_smallest("doc", min_docs).alias("docs"))
        found.append(keep(whole.where("asks").select("bucket", "leaf", "line").join(of_bucket, "bucket").select("leaf", "line", "docs"), "templates"))
        compared = [of_kind(rows, sizes, "small")]
        large = of_kind(rows, sizes, "large", "size")
        if split := sizes.where("kind = 'large'").limit(1).count():
            first = large.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(F.element_at("docs", 1), "line"))).where(F.col("r") <= pivots)
            first = first.groupBy("bucket", "size").agg(F.collect_list(F.struct("tokens", "docs")).alias("pivots"))
            # a bucket's lines are dealt over as many tasks as they fill, with its pivots in each
            salts = F.ceil(F.col("size") / bucket).cast("int")
            first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("size")
            dealt = large.withColumn("salt", F.pmod(F.xxhash64("line"), salts).cast("int")).drop("size").join(first, ["bucket", "salt"])
            dealt = dealt.sortWithinPartitions("bucket").drop("salt")
            seen = keep(dealt.mapInArrow(_settled(min_docs), _BUCKETS + ", found array<long>"), "settled")
            found.append(seen.where(F.size("found") > 0).select("leaf", "line", F.col("found").alias("docs")))
            large = seen.drop("found")
            left = _sizes(large, bucket)
            spent.append(left)
            compared.append(of_kind(large, left, "small"))
            large = of_kind(large, left, "large")
            split = left.where("kind = 'large'").limit(1).count()
        columns = ["bucket", "leaf", "line", "tokens", "docs", "asks"]
        small = reduce(DataFrame.union, [c.select(columns) for c in compared]).repartition("bucket").sortWithinPartitions("bucket")
        found.append(keep(small.mapInArrow(_compared(min_docs), _FOUND), "templates"))
        if not split:
            break
        rows = large.mapInArrow(_split, _BUCKETS)
    every = reduce(DataFrame.union, found).select("leaf", "line", F.explode("docs").alias("doc")).groupBy("leaf", "line").agg(_smallest("doc", min_docs).alias("docs"))
    out = stored(every, "shared")
    for table in spent:
        discard(table)
    return out


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, leave_copies: bool = False) -> DataFrame:
    """doc_id and dropped, the hashes (as parsed, or exact) of its lines that go, of every document that loses lines.

    With ``leave_copies`` long lines stay in a document that would lose half of its tokens or more by them.
    """
    ship(docs.sparkSession)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lines = stored(rows.mapInArrow(_parsed(min_tokens), "doc_id long, leaf long, line long, exact long, tokens binary"), "lines")
    # only leaves with enough lines can hold a recurring template; stored, so that Spark can split the lines of a
    # frequent leaf over tasks; joined by merging at every size, as they grow with the corpus
    leaves = stored(lines.groupBy("leaf").agg(F.count("*").alias("leaf_lines")).where(F.col("leaf_lines") >= min_docs).select("leaf"), "leaves")
    held = lines.join(leaves.hint("merge"), "leaf").select("leaf", "line", "tokens", "doc_id")
    # of a line in many documents no more than those that are needed leave a task
    first = held.withColumn("r", F.dense_rank().over(Window.partitionBy("leaf", "line", "tokens").orderBy("doc_id"))).where(F.col("r") <= min_docs)
    distinct = stored(first.groupBy("leaf", "line", "tokens").agg(_smallest("doc_id", min_docs).alias("docs")), "distinct")
    shared = shared_templates(distinct, min_docs)
    found = stored(shared.where(F.size("docs") >= min_docs).select("leaf", "line", F.element_at("docs", 1).alias("first_doc")), "recurring")
    dropped = lines.select("doc_id", "leaf", "line").join(found.hint("merge"), ["leaf", "line"]).where("doc_id <> first_doc")
    return dropped.select("doc_id", "line").union(_long_lines(lines, leave_copies)).groupBy("doc_id").agg(F.collect_set("line").alias("dropped"))


def _long_lines(lines: DataFrame, leave_copies: bool) -> DataFrame:
    """doc_id and exact hash of the long lines that another document with a smaller doc_id holds as they are."""
    size = F.octet_length("tokens") / 2
    long = lines.where(size >= LONG_TOKENS).select("doc_id", "exact", size.alias("size"))
    twice = long.groupBy("exact").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc <> last_doc")
    found = long.join(twice, "exact").where("doc_id <> first_doc")
    if leave_copies:
        lost = found.groupBy("doc_id").agg(F.sum("size").alias("lost"))
        whole = lines.groupBy("doc_id").agg(F.sum(size).alias("size"))
        found = found.join(lost.join(whole, "doc_id").where(F.col("lost") * 2 < F.col("size")).select("doc_id"), "doc_id")
    return found.select("doc_id", F.col("exact").alias("line"))


def deduplicated(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, leave_copies: bool = False, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``, and the ``counts`` of its lines and of those dropped (which replace columns of these names); n_chars follows the text where there is such a column."""
    of, gone_name = (free_name(c, [*docs.columns, *counts]) for c in ("dropped_of", "dropped"))
    dropped = dropped_lines(docs, min_docs, min_tokens, leave_copies).select(F.col("doc_id").alias(of), F.col("dropped").alias(gone_name))
    base = docs.drop(*counts)
    joined = base.join(dropped, F.col("doc_id") == F.col(of), "left").drop(of)
    at = base.columns.index("text")
    schema = T.StructType([*base.schema.fields, *[T.StructField(c, T.LongType()) for c in counts]])

    def run(batches):
        for batch in slices(batches, at):
            texts, gone = batch.column(at).to_pylist(), batch.column(gone_name).to_pylist()
            n_lines = [0 if t is None else t.count("\n") + 1 for t in texts]
            n_dropped = [0] * len(texts)
            for i, (t, d) in enumerate(zip(texts, gone)):
                if d and t:
                    own = Lines([t], min_tokens)
                    gone_here = np.array(d, np.int64)
                    lost = set(own.number[np.isin(own.hash, gone_here) | np.isin(own.exact, gone_here)].tolist())
                    n_dropped[i] = len(lost)
                    texts[i] = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in lost)
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(len(batch.columns) - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*batch.schema.names[:-1], *counts]
            )

    kept = joined.mapInArrow(run, schema)
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept

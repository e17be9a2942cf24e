"""Exact top-k search by inner product: columnar branch-and-bound.

Vectors become whole numbers, floor(64 * x). Candidates lie in blocks in
vertical layout (dimension by dimension), queries in blocks of rows; every
query block meets every candidate block once, in a task of its own. There

* dimensions are taken in the order of what they add to scores (energy);
* the first candidates, a part by chance as blocks are dealt by a hash, are
  scored whole, and each query's k-th best of them is its bar from then on,
  which rises with every later part of the block;
* in later parts, scores accumulate dimension block by dimension block. What
  the remaining dimensions can add is bounded by the product of the remaining
  norms (Cauchy-Schwarz). A candidate that no query of a group needs any more
  is compacted away; queries are sorted so that those of a group point the
  same way. Where few pairs are left, each is finished by itself.

Each pair of blocks returns k rows a query, and a window keeps the best of
them. ``Work`` counts the products that the bounds saved.

Defined cases: vectors that are null, or hold null or non-finite components,
take no part; shorter vectors count as padded by zeros; of rows that repeat a
vec_id each is a candidate of its own, all but the query's vec_id, and the
query vector is the smallest of them; scores beyond 64 bits are clamped; other
columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weavegrid.llm.common import few_rows_a_batch, ship, stored

SCALE = 64
K = 20
DIMENSION_BLOCK = 8
CANDIDATES_MOST, QUERIES_MOST = 32768, 16384
CANDIDATES_LEAST, QUERIES_LEAST = 2048, 256
BLOCK_BYTES = 1 << 24
#: Queries that share a list of surviving candidates, and signs by which they are sorted; candidates of a block's first part, and of later ones.
GROUP, SIGNS = 64, 8
FIRST, LATER = 512, 4096
#: Below this share of needed pairs each is finished by itself.
FEW = 0.05
#: Every so manieth candidate shows whether looking at all of them would pay.
SPARSE = 16
NOBODY = np.iinfo(np.int64).max


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the vectors that take part, as whole numbers in doubles."""
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def _blocked(dims: int, vertical: bool):
    """Rows sorted by block to one row for each block."""

    def packed(block: int, ids: list[np.ndarray], rows: list[np.ndarray]):
        m = np.concatenate(rows)
        data = np.ascontiguousarray(m.T if vertical else m)
        small = np.abs(data).max(initial=0) < 2**15
        data = data.astype("<i2" if small else "<f8").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.concatenate(ids).astype("<i8").tobytes()]), pa.array([data])], names=["block", "ids", "data"])

    def padded(vectors: pa.ListArray) -> np.ndarray:
        size = vectors.value_lengths().to_numpy()
        m = np.zeros((len(size), dims))
        row = np.repeat(np.arange(len(size)), size)
        m[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = vectors.flatten().to_numpy()
        return m

    def run(batches):
        last, ids, rows = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            block, own, m = batch.column("block").to_numpy(), batch.column("vec_id").to_numpy(), padded(batch.column("v"))
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                if ids and block[a] != last:
                    yield packed(last, ids, rows)
                    ids, rows = [], []
                last = block[a]
                ids.append(own[a:b])
                rows.append(m[a:b])
        if ids:
            yield packed(last, ids, rows)

    return run


def _matrix(data: bytes, n: int, dims: int) -> np.ndarray:
    kind = "<i2" if len(data) == 2 * n * dims else "<f8"
    return np.frombuffer(data, kind).astype(np.float64)


@dataclass
class Work:
    """Products of components that a search made, and those of all pairs."""

    made: int = 0
    all: int = 0


def _likewise(q: np.ndarray) -> np.ndarray:
    """An order of the queries in which those next to each other point the same way: by the signs of their first dimensions."""
    signs = (q[:, :SIGNS] > 0).astype(np.int64)
    return np.argsort(signs @ (1 << np.arange(signs.shape[1]))[::-1], kind="stable")


def best_of_block(q: np.ndarray, q_ids: np.ndarray, columns: np.ndarray, c_ids: np.ndarray, k: int, work: Work | None = None, held: dict | None = None):
    """For each query row (indices of) its k best candidates of the block and their scores.

    columns: dims x n, the vertical layout. held: what was found in other
    blocks, by query row; it gives the bars, is joined in and brought up to date.
    """
    dims, n = columns.shape
    if max(np.abs(q).max(initial=0), 1) * max(np.abs(columns).max(initial=0), 1) * max(dims, 1) >= 2**53:
        for i, ids, score in _exact_large(q, q_ids, columns, c_ids, k):
            if held and i in held:
                found = sorted(zip((-x for x in [*held[i][1].tolist(), *score.tolist()]), [*held[i][0].tolist(), *ids.tolist()]))[:k]
                ids, score = np.array([d for _, d in found], np.int64), np.array([-x for x, _ in found], np.int64)
            if held is not None:
                held[i] = ids, score
            yield i, ids, score
        return
    work = work or Work()
    work.all += q.size * n
    energy = np.argsort(-((columns**2).sum(axis=1) * (q**2).sum(axis=0)), kind="stable")
    order = _likewise(q[:, energy])
    q, q_ids, columns = q[order][:, energy], q_ids[order], columns[energy]
    cuts = [*range(0, dims, DIMENSION_BLOCK), dims]
    # what is left of each norm from each cut on
    left = lambda x: np.sqrt(np.cumsum((x**2)[:, ::-1], axis=1)[:, ::-1][:, cuts[:-1]]) if dims else np.zeros((len(x), 1))
    q_left, c_left = left(q), left(columns.T)
    for first in range(0, len(q), GROUP):
        own = slice(first, min(first + GROUP, len(q)))
        best_s, best_i = np.full((own.stop - first, k), -np.inf), np.full((own.stop - first, k), NOBODY)
        for i in range(own.stop - first) if held else ():
            if (before := held.get(int(order[first + i]))) is not None:
                best_i[i, : len(before[0])], best_s[i, : len(before[0])] = before
        at, size = 0, FIRST
        while at < n:
            part = slice(at, min(at + size, n))
            bar = best_s.min(axis=1, initial=np.inf)
            rows, ids, score = _survivors(q[own], q_left[own], columns[:, part], c_left[part], c_ids[part], cuts, bar, work)
            keep = ids != q_ids[own][rows]
            best_s, best_i = _merged(best_s, best_i, rows[keep], ids[keep], score[keep], k)
            at, size = part.stop, LATER
        for i in range(own.stop - first):
            found = best_s[i] > -np.inf
            if found.any():
                row = int(order[first + i]), best_i[i][found], best_s[i][found].astype(np.int64)
                if held is not None:
                    held[row[0]] = row[1:]
                yield row


def _survivors(q, q_left, columns, c_left, c_ids, cuts, bar, work):
    """Query rows, candidates' ids and scores of all pairs that may reach their query's bar."""
    dims = cuts[-1]
    ids, score = c_ids, np.zeros((len(q), columns.shape[1]))
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        score += q[:, a:b] @ columns[a:b]
        work.made += score.size * (b - a)
        if b == dims or not np.isfinite(bar).any():
            continue

        def needed_of(step):
            slack = q_left[:, number + 1][:, None] * c_left[::step, number + 1][None, :]  # noqa: B023
            return score[:, ::step] + slack * (1 + 1e-12) + 1e-6 >= bar[:, None]  # noqa: B023

        if score.shape[1] > 16 * SPARSE:
            some = needed_of(SPARSE)
            if some.mean() >= FEW and some.any(axis=0).mean() >= 0.7:
                continue
        needed = needed_of(1)
        share = np.count_nonzero(needed) / max(needed.size, 1)
        if share < FEW:
            rows, at = np.nonzero(needed)
            rest = np.einsum("ij,ij->i", q[rows, b:], columns[b:, at].T)
            work.made += rows.size * (dims - b)
            return rows, ids[at], score[rows, at] + rest
        anyone = needed.any(axis=0)
        if anyone.mean() < 0.7:  # else copying costs more than it saves
            columns, ids, score, c_left = columns[:, anyone], ids[anyone], score[:, anyone], c_left[anyone]
    rows, at = np.nonzero(score >= bar[:, None])
    return rows, ids[at], score[rows, at]


def _merged(best_s, best_i, rows, ids, score, k):
    """The k best of each row: of those held and the new ones, by score, then id."""
    held = np.repeat(np.arange(len(best_s)), k)
    rows, ids, score = np.concatenate([held, rows]), np.concatenate([best_i.ravel(), ids]), np.concatenate([best_s.ravel(), score])
    order = np.lexsort((ids, -score, rows))
    rows, ids, score = rows[order], ids[order], score[order]
    first = np.searchsorted(rows, np.arange(len(best_s)))
    take = first[:, None] + np.arange(k)[None, :]
    return score[take], ids[take]


def _exact_large(q, q_ids, columns, c_ids, k):
    """Scores beyond the whole numbers of doubles: Python's integers, clamped to 64 bits."""
    whole = [[int(x) for x in c] for c in columns.T]
    for i in range(len(q)):
        v = [int(x) for x in q[i]]
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, c)))), int(d)) for c, d in zip(whole, c_ids) if d != q_ids[i])[:k]
        yield i, np.array([d for _, d in scored], np.int64), np.array([-s for s, _ in scored], np.int64)


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of every query; is_query: a condition on vec_id."""
    spark = vectors.sparkSession
    ship(spark)
    whole = whole_vectors(vectors)
    n, dims = whole.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    queries = whole.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_queries = whole.where(is_query).count()
    ways = max(2, spark.sparkContext.defaultParallelism)

    def blocks(rows, count, least, most, vertical, name):
        most = max(least // 8, min(most, BLOCK_BYTES // (8 * max(dims, 1))))
        n_blocks = max(1, math.ceil(count / most), min(ways, math.ceil(count / least)))
        # rows that repeat as a whole are dealt by where they were read
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v", F.spark_partition_id()), F.lit(n_blocks)).cast("int"))
        return stored(dealt.repartition(n_blocks, "block").sortWithinPartitions("block").select("block", "vec_id", "v").mapInArrow(_blocked(dims, vertical), "block int, ids binary, data binary"), name), n_blocks

    c, nc = blocks(whole, n, CANDIDATES_LEAST, CANDIDATES_MOST, True, "candidates")
    q, nq = blocks(queries, n_queries, QUERIES_LEAST, QUERIES_MOST, False, "queries")
    # every pair of blocks once, by an equi-join on the pair's number; a task takes a run of candidate blocks for one
    # query block, in turn, and what it found so far gives the bars of the next
    runs = max(1, min(nc, 4 * ways // nq))
    ends = lambda c, q: [(c * F.lit(nq) + q).alias("pair"), (q * F.lit(runs) + c % F.lit(runs)).alias("run")]
    c = c.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).select(*ends(F.col("block"), F.col("other")), "ids", "data")
    q = q.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nc - 1)))).select(ends(F.col("other"), F.col("block"))[0], F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))

    def batch_of(rows, q_ids):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(len(d), q_ids[i]) for i, (d, _) in rows])), *[pa.array(np.concatenate([x[j] for _, x in rows])) for j in (0, 1)]],
            names=["query_id", "vec_id", "score"],
        )

    def run(batches):
        last, held, of = None, {}, None
        for batch in batches:
            for at, c_ids, c_data, q_ids, q_data in zip(*(batch.column(x).to_pylist() for x in ("run", "ids", "data", "q_ids", "q_data"))):
                if at != last and held:
                    yield batch_of(list(held.items()), of)
                    held = {}
                last, of = at, np.frombuffer(q_ids, "<i8")
                c_ids = np.frombuffer(c_ids, "<i8")
                columns = _matrix(c_data, len(c_ids), dims).reshape(dims, len(c_ids))
                for _ in best_of_block(_matrix(q_data, len(of), dims).reshape(len(of), dims), of, columns, c_ids, k, held=held):
                    pass
        if held:
            yield batch_of(list(held.items()), of)

    pairs = c.join(q.hint("shuffle_hash"), "pair").repartition(nq * runs, "run").sortWithinPartitions("run").select("run", "ids", "data", "q_ids", "q_data")
    with few_rows_a_batch(spark, 4):  # rows are of some megabytes
        found = stored(pairs.mapInArrow(run, "query_id long, vec_id long, score long"), "found")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

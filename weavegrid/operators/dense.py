"""Vector retrieval by cosine, in blocks.

Rows of vectors become matrices, one for each Arrow batch, where they are
read; queries become blocks of ``QUERY_BLOCK``. Every block of rows meets
every block of queries in an equi-join (broadcast, where the queries are
small), and a task multiplies the two. Of a top-k only k rows a query and
block leave the task. Vectors that are null, empty or zero, or hold null or
non-finite components, score with nothing; shorter ones count as padded by
zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weavegrid.functions.config import RETRIEVAL
from weavegrid.operators.scratch import ship
from weavegrid.operators.sparse import ranked, small

QUERY_BLOCK = 512
#: Bytes of a block of vectors, and rows of it that are multiplied at a time.
BLOCK_BYTES = 1 << 21
TILE = 4096
DIGITS = 6


def augmented(query: Column, phrases: Column) -> Column:
    """A query's text followed by its phrases, kind: phrase."""
    listed = F.transform(F.map_entries(phrases), lambda e: F.concat(e["key"], F.lit(": "), F.array_join(e["value"], " and ")))
    return F.concat_ws(" ", query, F.array_join(listed, " "))


def _units(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, and the places of those that have one."""
    size = np.nan_to_num(pc.list_value_length(vectors).to_numpy(zero_copy_only=False)).astype(np.int64)
    m = np.zeros((len(size), int(size.max(initial=0))))
    row = np.repeat(np.arange(len(size)), size)
    m[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = vectors.flatten().to_numpy(zero_copy_only=False)
    norm = np.sqrt((m * m).sum(axis=1))
    has = np.flatnonzero(np.isfinite(norm) & (norm > 0))
    return m[has] / norm[has, None], has


def _blocked(block_bytes: int):
    """Arrow batches of id and vector to rows of blocks: ids, and unit vectors as a matrix."""

    def run(batches):
        for batch in batches:
            units, has = _units(batch.column(1))
            step = max(1, block_bytes // (8 * max(units.shape[1], 1)))
            for at in range(0, len(has), step):
                ids, part = batch.column(0).take(pa.array(has[at : at + step])), units[at : at + step]
                packed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([packed, pa.array([part.shape[1]], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["ids", "dims", "data"])

    return run


def _rows(batch: pa.RecordBatch, prefix: str, row: int) -> tuple[pa.Array, np.ndarray]:
    dims = batch.column(f"{prefix}dims")[row].as_py()
    return batch.column(f"{prefix}ids")[row].values, np.frombuffer(batch.column(f"{prefix}data")[row].as_py()).reshape(-1, dims)


def _best(scores: np.ndarray, order_of: np.ndarray, k: int | None, threshold: float | None):
    """Query and row numbers of the pairs that count: at or above the threshold, the first k by rounded score, then id."""
    able = np.ones(scores.shape, bool) if threshold is None else scores >= threshold
    if k is None or k >= scores.shape[1]:
        return np.nonzero(able)
    near = np.round(scores, DIGITS)
    near[~able] = -np.inf
    bar = -np.partition(-near, k - 1, axis=1)[:, k - 1]  # all that tie with the k-th
    q, r = np.nonzero(able & (near >= bar[:, None]))
    order = np.lexsort((order_of[r], -near[q, r], q))
    q, r = q[order], r[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], r[place < k]


def _scored(k: int | None, threshold: float | None, tile: int):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, vectors = _rows(batch, "", row)
                q_ids, queries = _rows(batch, "q_", row)
                dims = min(vectors.shape[1], queries.shape[1])
                order_of = pc.rank(ids).to_numpy() if k is not None else np.zeros(len(ids))
                for at in range(0, len(vectors), tile):
                    scores = queries[:, :dims] @ vectors[at : at + tile, :dims].T
                    q, r = _best(scores, order_of[at : at + tile], k, threshold)
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(q)), ids.take(pa.array(r + at)), pa.array(scores[q, r])], names=["query_id", "vec_id", "score"])

    return run


def block_scores(vectors: DataFrame, queries: DataFrame, threshold: float | None = RETRIEVAL.dense_threshold, k: int | None = None) -> DataFrame:
    """query_id, vec_id, score at or above the threshold; with k, the best k of each query and block at most."""
    ship(vectors.sparkSession)
    kinds = dict(vectors.dtypes) | dict(queries.dtypes)
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    packed = lambda rows, key: rows.mapInArrow(_blocked(BLOCK_BYTES), f"ids array<{kinds[key]}>, dims int, data binary")
    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).repartition(blocks, "query_id")
    asked = packed(asked, "query_id").select(F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("data").alias("q_data"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("q_ids"), F.lit(blocks)).cast("int"))
    rows = packed(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "vec_id")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = rows.join(small(asked, n, 8 * 1536), "block").drop("block")
    return pairs.mapInArrow(_scored(k, threshold, TILE), f"query_id {kinds['query_id']}, vec_id {kinds['vec_id']}, score double")


def cosine_scores(vectors: DataFrame, queries: DataFrame, threshold: float | None = RETRIEVAL.dense_threshold) -> DataFrame:
    """query_id, vec_id, score at or above the threshold, a stated set of queries against all rows.

    vectors: vec_id, embedding; queries: query_id, query.
    """
    return block_scores(vectors, queries, threshold)


def topk(vectors: DataFrame, queries: DataFrame, k: int = RETRIEVAL.k, threshold: float | None = RETRIEVAL.dense_threshold) -> DataFrame:
    """query_id, vec_id, score, rank of the k best; k rows a query and block are shuffled."""
    return ranked(block_scores(vectors, queries, threshold, k), k, entry="vec_id", digits=DIGITS)


def centroids(vectors: DataFrame) -> DataFrame:
    """query_id (label), query: the mean vector of each label."""
    each = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select(F.col("label").alias("query_id"), F.transform("v", lambda p: p["x"]).alias("query"))


def near_zero_dropped(hits: DataFrame, floor: float = RETRIEVAL.near_zero) -> DataFrame:
    return hits.where(F.col("score") > floor)

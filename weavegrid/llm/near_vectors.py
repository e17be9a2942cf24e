"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated to their principal directions and split into blocks
of ``BLOCK_DIMS`` dimensions. A cosine of t or more is a squared distance of
2 - 2t or less; each block has a share of that budget, in proportion to its
share of the variance. Were a pair beyond the budget of every block, it would
be beyond the whole: so the pairs within the budget of one block or more hold
all links. Those are found and verified with the given vectors in double
precision.

Equal vectors become one class first, with their number. Classes are dealt
into the leaves of a k-d tree over the rotated space, large leaves into chunks.
Two leaves meet where their boxes lie within the budget in a block (and within
the whole budget in all of them), and a pair of chunks meets once, whatever the
number of its blocks: there each block is
range-joined and the union of what they find is verified, so no pair counts
twice. From a pair of chunks only numbers of links and a spanning forest leave
(a row or two a vector), never the pairs.

The rotation and the tree are fitted on at most ``SAMPLE_ROWS`` classes, those
with the smallest hashes; every vector is indexed, and what is found doesn't
depend on the fit. Where vectors point in all directions alike, all boxes are
near each other and every chunk meets every other one.

Defined cases: vectors that are null, empty or zero, or hold null or
non-finite components, link with nothing; shorter vectors count as padded by
zeros; rows that repeat a vec_id are vectors of their own; a row without a
vec_id counts as a link of others and is kept, and gives no component its id;
other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weavegrid.llm.common import connected_components, discard, few_rows_a_batch, ship, stored
from weavegrid.llm.ngram_join import _runs

THRESHOLD = 0.95
BLOCK_DIMS = 8
SAMPLE_ROWS, SAMPLE_BYTES = 4096, 1 << 25
LEAVES_MOST = 512
CHUNK_LEAST, CHUNK_MOST, CHUNK_BYTES = 1024, 16384, 1 << 22
#: Rows of a chunk that are compared with another at a time, and pairs that are verified at a time.
TILE_ROWS, VERIFIED = 256, 1 << 16
#: Room for the rounding of single precision in a block's squared distances.
SLACK = 1e-5


def _matrix(vectors: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows, padded by zeros."""
    size = vectors.value_lengths().to_numpy()
    m = np.zeros((len(size), dims))
    row = np.repeat(np.arange(len(size)), size)
    m[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = vectors.flatten().to_numpy()
    return m


def _units(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, initial=0, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


class Subspaces:
    """A rotation, its blocks with their budgets, and a k-d tree over the rotated space."""

    def __init__(self, sample: np.ndarray, leaves: int, threshold: float = THRESHOLD, block_dims: int = BLOCK_DIMS):
        dims = sample.shape[1]
        spread, axes = np.linalg.eigh(np.cov(sample.T).reshape(dims, dims) if len(sample) > 1 else np.eye(dims))
        self.rotation = axes[:, ::-1]
        spread = np.maximum(spread[::-1], 0)
        cuts = [(a, min(a + block_dims, dims)) for a in range(0, dims, block_dims)]
        share = np.array([spread[a:b].sum() for a, b in cuts])
        share = share / share.sum() if share.sum() > 0 else np.full(len(cuts), 1 / len(cuts))
        used = share >= share.max() * 1e-4  # a block without spread tells nothing apart; the others' budgets make up the whole
        share = share[used] / share[used].sum()
        #: (first, last + 1, budget) of each block
        self.blocks = [(a, b, float((2 - 2 * threshold) * s)) for (a, b), s in zip(np.array(cuts)[used].tolist(), share)]
        self.depth = int(math.log2(leaves))
        self.axis, self.cut = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth)
        self._split(sample @ self.rotation, 1, 0)

    def _split(self, rows: np.ndarray, node: int, depth: int) -> None:
        if depth < self.depth:
            axis = int(rows.std(axis=0).argmax()) if len(rows) else 0
            cut = float(np.median(rows[:, axis])) if len(rows) else 0.0
            self.axis[node], self.cut[node] = axis, cut
            above = rows[:, axis] > cut
            self._split(rows[~above], 2 * node, depth + 1)
            self._split(rows[above], 2 * node + 1, depth + 1)

    def leaf(self, rotated: np.ndarray) -> np.ndarray:
        node = np.ones(len(rotated), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (rotated[np.arange(len(node)), self.axis[node]] > self.cut[node])
        return node - (1 << self.depth)

    def meeting(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which boxes (rows of low and high) lie within the budget of a block of which others, and within the whole in all blocks together."""
        near, whole = np.zeros((len(low), len(low)), bool), np.zeros((len(low), len(low)))
        for a, b, budget in self.blocks:
            apart = np.zeros(near.shape)
            for d in range(a, b):
                gap = np.maximum(low[:, None, d] - high[None, :, d], low[None, :, d] - high[:, None, d])
                apart += np.square(np.maximum(gap, 0))
            near |= apart <= budget + SLACK
            whole += apart
        return near & (whole <= sum(budget for *_, budget in self.blocks) + SLACK)

    def links(self, a: np.ndarray, b: np.ndarray, threshold: float, same: bool):
        """Linked rows of a and b, a tile of a at a time; same: a and b are one chunk, of which each pair counts once."""
        ra, rb = ((x @ self.rotation).astype(np.float32) for x in (a, b))
        for first in range(0, len(a), TILE_ROWS):
            tile = ra[first : first + TILE_ROWS]
            others = slice(first, None) if same else slice(None)
            found = np.zeros((len(tile), len(rb[others])), bool)
            for x, y, budget in self.blocks:
                p, q = tile[:, x:y], rb[others, x:y]
                apart = np.einsum("ij,ij->i", p, p)[:, None] + np.einsum("ij,ij->i", q, q)[None, :]
                apart -= 2 * (p @ q.T)
                found |= apart <= np.float32(budget + SLACK)
            if same:
                found &= np.arange(found.shape[1])[None, :] > np.arange(len(tile))[:, None]
            i, j = np.nonzero(found)
            i, j = i + first, j + (first if same else 0)
            for at in range(0, len(i), VERIFIED):
                own, other = i[at : at + VERIFIED], j[at : at + VERIFIED]
                linked = np.einsum("ij,ij->i", a[own], b[other]) >= threshold
                yield own[linked], other[linked]


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least labels of the members of each group when a and b are linked."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def _placed(space: Subspaces, dims: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = space.leaf(_units(_matrix(batch.column("v"), dims)) @ space.rotation)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("copies"), batch.column("v"), pa.array(leaf.astype(np.int32))], names=["id", "copies", "v", "leaf"])

    return run


def _packed(space: Subspaces, dims: int, kind: str):
    def run(batches):
        for t in _runs(batches, "leaf", "chunk"):
            vectors = t.column("v").combine_chunks()
            m = _matrix(vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors, dims)
            rotated = _units(m) @ space.rotation
            first = [t.column(c)[:1].combine_chunks() for c in ("leaf", "chunk")]
            bytes_of = [t.column(c).to_numpy().astype("<i8").tobytes() for c in ("id", "copies")]
            box = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (rotated.min(axis=0), rotated.max(axis=0))]
            yield pa.RecordBatch.from_arrays([*first, *[pa.array([x], pa.binary()) for x in (*bytes_of, m.astype(kind).tobytes())], *box], names=["leaf", "chunk", "ids", "copies", "data", "low", "high"])

    return run


def _compared(space: Subspaces, dims: int, kind: str, threshold: float):
    def run(batches):
        for t in _runs(batches, "leaf_a", "chunk_a", "leaf_b", "chunk_b"):
            ids, copies = ([np.frombuffer(x, "<i8") for x in t.column(c).to_pylist()] for c in ("ids", "copies"))
            units = [_units(np.frombuffer(x, kind).astype(np.float64).reshape(-1, dims)) for x in t.column("data").to_pylist()]
            same = len(units) == 1
            shift = 0 if same else len(ids[0])
            all_ids, weight = np.concatenate(ids), np.concatenate(copies)
            label, links = np.arange(len(all_ids)), np.zeros(len(all_ids), np.int64)
            for a, b in space.links(units[0], units[-1], threshold, same):
                b = b + shift
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                label = _merged(label, a, b)
            has = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(all_ids[has]), pa.array(links[has]), pa.array(all_ids[label[has]])], names=["id", "links", "root"])

    return run


def _valid():
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & F.exists("embedding", lambda x: x.cast("double") != 0), F.lit(False))


def near_classes(vectors: DataFrame, threshold: float = THRESHOLD, chunk_most: int = CHUNK_MOST, leaves_most: int = LEAVES_MOST, block_dims: int = BLOCK_DIMS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    ship(spark)
    valid = _valid()
    keys = ["key", "key2"]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(valid, F.col("embedding")).alias("v"))
    rows = rows.withColumns({"key": F.xxhash64("v"), "key2": F.xxhash64(F.lit(1), "v")})
    classes = rows.where("v is not null").groupBy(*keys).agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes", tidy=True)
    n, dims = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    size = max(1, min(chunk_most, max(CHUNK_LEAST, n // 8), CHUNK_BYTES // (int(kind[-1]) * dims)))
    sample = classes.orderBy("key").select("v").limit(max(64, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))).toArrow().column("v")
    sample = _units(np.concatenate([_matrix(x, dims) for x in sample.chunks]))
    leaves = 1 << max(0, min(leaves_most, n // size, len(sample) // 4).bit_length() - 1)
    space = Subspaces(sample, leaves, threshold, block_dims)

    placed = stored(classes.select("id", "copies", "v").mapInArrow(_placed(space, dims), f"id long, copies long, v {dict(classes.dtypes)['v']}, leaf int"), "placed")
    counts = placed.groupBy("leaf").agg(F.ceil(F.count("*") / size).cast("int").alias("chunks"))
    chunks_of = {r.leaf: r.chunks for r in counts.collect()}  # at most ``leaves`` rows
    counts = spark.createDataFrame(sorted(chunks_of.items()), "leaf int, chunks int")
    dealt = placed.join(F.broadcast(counts), "leaf").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = dealt.repartition("leaf", "chunk").sortWithinPartitions("leaf", "chunk").select("leaf", "chunk", "id", "copies", "v")
    packed = stored(dealt.mapInArrow(_packed(space, dims, kind), "leaf int, chunk int, ids binary, copies binary, data binary, low array<double>, high array<double>"), "chunks", tidy=True)

    # boxes of the leaves: at most leaves * dims rows
    sides = packed.select("leaf", F.posexplode(F.arrays_zip("low", "high")).alias("d", "x")).groupBy("leaf", "d").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).toArrow()
    of = sorted(chunks_of)
    low, high = np.zeros((len(of), dims)), np.zeros((len(of), dims))
    at = np.searchsorted(of, sides.column("leaf").to_numpy()), sides.column("d").to_numpy()
    low[at], high[at] = sides.column("low").to_numpy(), sides.column("high").to_numpy()
    meets = [(of[i], of[j], chunks_of[of[j]]) for i, j in np.argwhere(space.meeting(low, high)).tolist()]
    meetings = sum(chunks_of[i] * c for i, _, c in meets) // 2 + 1
    tasks = max(1, min(meetings, max(4 * spark.sparkContext.defaultParallelism, meetings // 16)))

    own, other = F.struct("leaf", "chunk"), F.struct(F.col("other").alias("leaf"), F.col("other_chunk").alias("chunk"))
    pairs = packed.drop("low", "high").join(F.broadcast(spark.createDataFrame(meets, "leaf int, other int, chunks int")), "leaf")
    pairs = pairs.withColumn("other_chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumns({"a": F.least(own, other), "b": F.greatest(own, other)})
    key = [F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("leaf", "chunk")]
    names = ["leaf_a", "chunk_a", "leaf_b", "chunk_b"]
    pairs = pairs.select(*key, "leaf", "chunk", "ids", "copies", "data").repartition(tasks, *names).sortWithinPartitions(*names, "leaf", "chunk")
    with few_rows_a_batch(spark, 4):  # rows are of some megabytes
        found = stored(pairs.mapInArrow(_compared(space, dims, kind, threshold), "id long, links long, root long"), "found", tidy=True)

    groups = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    named = classes.select("id", "least").join(groups.withColumnRenamed("node", "id"), "id")
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("id", "component_id")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    result = classes.join(links, "id", "left").join(named, "id", "left")
    result = stored(result.select(*keys, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "classes", tidy=True)
    for table in (classes, placed, packed, found):
        discard(table)
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    whole = rows.where("v is not null").drop("v").join(result, keys).select("vec_id", "n_links", "component_id").union(alone)
    return whole.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

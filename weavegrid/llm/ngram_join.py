"""N-gram Jaccard self-join by chosen paths.

``jaccard_classes`` links documents whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more, and returns for each document the group it
belongs to and how many documents it is linked with.

1. Each text becomes its shingle set; texts with equal sets form one class of
   copies, which goes on as one row.
2. Chosen paths: a class has 128 minwise coordinates. In each run every node
   (at first the run itself) picks ``BRANCH`` coordinates; the class moves to
   the child named by its value there, so classes in a child share a sampled
   token. A child larger than ``SMALL`` is split again, down to ``LEVELS``.
   A pair at the threshold shares a final bucket of one run with probability
   ``path_recall()``; ``runs_for`` repeats runs up to the target recall.
3. Small buckets are compared by brute force on 128-byte sketches. The classes
   of a larger one are packed into blocks, one row each, and every pair of
   blocks is compared once. Only a spanning forest of the candidate links
   leaves a bucket or pair.
4. The components of these links are compared exactly, in the same way: a text
   is sent once, to its component or, where that is large, to its block. Only
   the counts and a spanning forest of the true links leave. So rows stay in
   proportion to the input: a group of n near copies never becomes n * n rows,
   and its blocks pair as n * n / 2048 / 2048. No bucket or component is
   capped.

Defined cases: a null text counts as empty; texts without words are copies of
each other and of nothing else; very long texts are sets like any other, and a
block holds few of them; repeated rows count as documents of their own; a null
doc_id stays null in the result; other columns are ignored; no rows give no
rows. Copies are found by a 128-bit hash of the shingle set.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weavegrid.llm.common import connected_components, discard, few_rows_a_batch, ship, slices, stored, text_or_empty
from weavegrid.llm.shingles import hash_family, minhashes, mix, shingle_sets

THRESHOLD = 0.8
TARGET_RECALL = 0.999
COORDINATES = 128
BRANCH = 2
LEVELS = 3
SMALL = 256
#: A block holds about so many classes, and about so many bytes of shingle hashes, at most.
BLOCK_ROWS, BLOCK_BYTES = 2048, 1 << 23
#: Tokens in at least so many sets of a comparison become bits; rarer ones are counted pair by pair.
FREQUENT = 32
#: Sketch estimates have a standard deviation of 0.035 at the threshold; four of them lie between.
SKETCH_FLOOR = THRESHOLD - 0.15


def path_recall(threshold: float = THRESHOLD, levels: int = LEVELS) -> float:
    """Probability that two sets at the threshold share a bucket after ``levels`` splits of one run."""
    q = 1.0
    for _ in range(levels):
        q = 1 - (1 - threshold * q) ** BRANCH
    return q


def runs_for(target: float = TARGET_RECALL, threshold: float = THRESHOLD) -> int:
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - path_recall(threshold))))


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit halves of a hash of each set, in rows."""
    return np.frombuffer(b"".join(hashlib.md5(s.tobytes()).digest() for s in sets), "<i8").reshape(-1, 2)


def _signed(batches):
    a, b = hash_family(COORDINATES, 1)
    for part in slices(batches):
        sets = shingle_sets(part.column("text").to_pylist())
        keys = set_keys(sets)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                part.column("row"),
                pa.array(keys[:, 0]),
                pa.array(keys[:, 1]),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([minhashes(s, a, b).tobytes() for s in sets], pa.binary()),
            ],
            names=["doc_id", "row", "key", "key2", "n", "sig"],
        )


def _children(with_root: int):
    """Node and coordinates to child nodes; with_root: number of runs, when the parents are the runs themselves."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            key = batch.column("key").to_numpy()
            parents = [mix(np.full(len(key), r + 1, np.uint64)) for r in range(with_root)] or [batch.column("node").to_numpy().view(np.uint64)]
            nodes = []
            for p in parents:
                for j in range(BRANCH):
                    h = mix(p + np.uint64(j + 1))
                    at = (h % np.uint64(COORDINATES)).astype(np.int64)
                    nodes.append(mix(h ^ mix(sig[np.arange(len(key)), at].astype(np.uint64) + (at.astype(np.uint64) << np.uint64(32)))))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(key, len(nodes))), pa.array(np.concatenate(nodes).view(np.int64))], names=["key", "node"])

    return run


def _runs(batches, *columns: str):
    """Rows sorted by whole-number columns, in batches, to one table for each run of equal values."""
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


def _least_linked(linked: np.ndarray, label: np.ndarray) -> np.ndarray:
    """For each row of a link matrix the least label of its columns, or a larger number than any."""
    beyond = np.iinfo(np.int64).max
    step = max(1, (1 << 19) // max(linked.shape[1], 1))
    return np.concatenate([np.where(linked[i : i + step], label[None, :], beyond).min(axis=1, initial=beyond) for i in range(0, len(linked), step)])


def _forest(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """For each member the smallest one it is connected to; rows, columns: the members of the matrix's sides."""
    label = np.arange(1 + max(rows.max(initial=-1), columns.max(initial=-1)))
    turned = linked.T
    while True:
        best = label.copy()
        best[rows] = np.minimum(best[rows], _least_linked(linked, best[columns]))
        best[columns] = np.minimum(best[columns], _least_linked(turned, best[rows]))
        best = best[best]
        if (best == label).all():
            return label
        label = best


def _sides(blocks: list):
    """Members of one block, or of two: rows and columns of their link matrix."""
    first = np.arange(len(blocks[0]))
    return (first, first) if len(blocks) == 1 else (first, len(first) + np.arange(len(blocks[1])))


def _sketch_links(blocks: list[tuple[np.ndarray, np.ndarray]]):
    """A spanning forest of the candidate links within one block of (keys, sketches), or between two."""
    (key, sig), (other_key, other) = blocks[0], blocks[-1]
    need = int(np.ceil((SKETCH_FLOOR * 255 / 256 + 1 / 256) * sig.shape[1]))
    linked = np.zeros((len(key), len(other_key)), bool)
    step = max(1, (1 << 22) // (len(other_key) * sig.shape[1]))
    for i in range(0, len(key), step):
        linked[i : i + step] = np.count_nonzero(sig[i : i + step, None, :] == other[None, :, :], axis=2) >= need
    root = _forest(linked, *_sides([b[0] for b in blocks]))
    keys = np.concatenate([b[0] for b in blocks])
    moved = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(keys[moved]), pa.array(keys[root[moved]])], names=["a", "b"])


def _sketched(batches):
    for t in _runs(batches, "node"):
        if t.num_rows > 1:
            yield _sketch_links([(t.column("key").to_numpy(), np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(t.num_rows, -1))])


def _sketches_packed(batches):
    for t in _runs(batches, "node", "block"):
        first = [t.column(c)[:1].combine_chunks() for c in ("node", "block", "n_blocks")]
        yield pa.RecordBatch.from_arrays([*first, pa.array([t.column("key").to_numpy().tobytes()]), pa.array([b"".join(t.column("sketch").to_pylist())])], names=["node", "block", "n_blocks", "keys", "sketches"])


def _sketched_pairs(batches):
    for t in _runs(batches, "node", "low", "high"):
        keys = [np.frombuffer(k, np.int64) for k in t.column("keys").to_pylist()]
        yield _sketch_links([(k, np.frombuffer(s, np.uint8).reshape(len(k), -1)) for k, s in zip(keys, t.column("sketches").to_pylist())])


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of ``a`` shares with each of ``b``."""
    both = np.zeros((len(a), len(b)), np.int32)
    tokens, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    cut = sum(map(len, a))
    sides = [(np.repeat(np.arange(len(x)), [len(s) for s in x]), at[y]) for x, y in ((a, slice(0, cut)), (b, slice(cut, None)))]
    na, nb = (np.bincount(x, minlength=len(tokens)) for _, x in sides)
    frequent = (na > 0) & (nb > 0) & (na + nb >= FREQUENT)
    column = np.cumsum(frequent) - 1
    width = (int(frequent.sum()) + 63) // 64
    maps = []
    for (row, x), n in zip(sides, (len(a), len(b))):
        bits = np.zeros((n, width), np.uint64)
        keep = frequent[x]
        c = column[x[keep]]
        np.bitwise_or.at(bits, (row[keep], c // 64), np.uint64(1) << (c % 64).astype(np.uint64))
        maps.append(bits)
    step = max(1, (1 << 20) // (len(b) * max(width, 1)))
    if width:
        for i in range(0, len(a), step):
            both[i : i + step] = np.bitwise_count(maps[0][i : i + step, None, :] & maps[1][None, :, :]).sum(axis=2, dtype=np.int32)
    # of rarer tokens: each row of a that holds one, with each row of b that does
    rare = (na > 0) & (nb > 0) & ~frequent
    (row_a, x), (row_b, y) = ((row[rare[t]], t[rare[t]]) for row, t in sides)
    order = np.argsort(y, kind="stable")
    row_b, first = row_b[order], np.cumsum(nb * rare) - nb * rare
    for i in range(0, len(x), 1 << 16):
        own, r = x[i : i + (1 << 16)], row_a[i : i + (1 << 16)]
        n = nb[own]
        place = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
        np.add.at(both, (np.repeat(r, n), row_b[place]), 1)
    return both


def _exact_links(blocks: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]):
    """Links within one block of (keys, copies, sets), or between two: counts of linked documents and a spanning forest."""
    (_, weight, sets), (_, other_weight, others) = blocks[0], blocks[-1]
    both = _shared(sets, others)
    size, other_size = (np.array([len(s) for s in x], np.int64) for x in (sets, others))
    linked = np.zeros(both.shape, bool)
    links, other_links = np.zeros(len(sets), np.int64), np.zeros(len(others), np.int64)
    step = max(1, (1 << 19) // len(others))
    for i in range(0, len(sets), step):
        part = both[i : i + step].astype(np.int64)
        own = part * 5 >= 4 * (size[i : i + step, None] + other_size[None, :] - part)
        if len(blocks) == 1:
            own[np.arange(len(own)), i + np.arange(len(own))] = False
        linked[i : i + step] = own
        links[i : i + step] = np.where(own, other_weight[None, :], 0).sum(axis=1)
        if len(blocks) == 2:
            other_links += np.where(own, weight[i : i + step, None], 0).sum(axis=0)
    root = _forest(linked, *_sides([b[0] for b in blocks]))
    keys = np.concatenate([b[0] for b in blocks])
    counts = links if len(blocks) == 1 else np.concatenate([links, other_links])
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts), pa.array(keys[root])], names=["key", "links", "root"])


def _sets_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    sets = [s for part in slices(t.to_batches()) for s in shingle_sets(part.column("text").to_pylist())]
    return t.column("key").to_numpy(), t.column("copies").to_numpy(), sets


def _compared(batches):
    for t in _runs(batches, "near"):
        if t.num_rows > 1:
            yield _exact_links([_sets_of(t)])


def _sets_packed(batches):
    for t in _runs(batches, "near", "block"):
        keys, copies, sets = _sets_of(t)
        first = [t.column(c)[:1].combine_chunks() for c in ("near", "block", "n_blocks")]
        data = [keys.tobytes(), copies.tobytes(), np.array([len(s) for s in sets], np.int64).tobytes(), np.concatenate(sets).tobytes()]
        yield pa.RecordBatch.from_arrays([*first, *[pa.array([d], pa.binary()) for d in data]], names=["near", "block", "n_blocks", "keys", "copies", "sizes", "sets"])


def _compared_pairs(batches):
    for t in _runs(batches, "near", "low", "high"):
        blocks = []
        for row in t.to_pylist():
            ends = np.cumsum(np.frombuffer(row["sizes"], np.int64))[:-1]
            blocks.append((np.frombuffer(row["keys"], np.int64), np.frombuffer(row["copies"], np.int64), np.split(np.frombuffer(row["sets"], np.uint64), ends)))
        yield _exact_links(blocks)


def _in_blocks(members: DataFrame, sizes: DataFrame, of: str) -> DataFrame:
    """Members of a group with its n_blocks and, by their key, their block; members of groups that aren't in ``sizes`` go."""
    return members.join(sizes, of).withColumn("block", F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("int"))


def _by_pairs(blocks: DataFrame, of: str, run, schema: str, name: str) -> DataFrame:
    """Each pair of blocks of one group, and each block by itself, through ``run``. Blocks are few and large, so a batch holds few of them."""
    other = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    pairs = other.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other", "n_blocks")
    with few_rows_a_batch(blocks.sparkSession, 4):
        return stored(pairs.repartition(of, "low", "high").sortWithinPartitions(of, "low", "high", "block").mapInArrow(run, schema), name)


def jaccard_classes(docs: DataFrame, target_recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its group of linked documents), n_links (documents linked with it), one row per row of ``docs``."""
    return _grouped(docs, target_recall).select("doc_id", "class_id", "n_links")


def _grouped(docs: DataFrame, target_recall: float = TARGET_RECALL) -> DataFrame:
    """``jaccard_classes`` with key, key2 of the shingle set, and component, which tells groups apart that share a class_id."""
    ship(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    signed = stored(source.mapInArrow(_signed, "doc_id long, row long, key long, key2 long, n long, sig binary"), "signatures")
    grouped = signed.groupBy("key", "key2").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("sig").alias("sig"))
    classes = stored(grouped.withColumnRenamed("key", "half").withColumn("key", F.col("half")), "classes")
    if (same := classes.groupBy("key").count().where("count > 1").select("key")).limit(1).count():  # of 2 ** 32 classes one pair, on average
        same = classes.join(same, "key", "left_semi").select("half", "key2", F.xxhash64("half", "key2").alias("other"))
        classes = stored(classes.join(same, ["half", "key2"], "left").withColumn("key", F.coalesce("other", "key")).drop("other"), "classes")
    able = classes.where("n > 0")
    sketches = able.select("key", "sig").mapInArrow(_sketches, "key long, sketch binary")

    level = able.select("key", "sig").mapInArrow(_children(runs_for(target_recall)), "key long, node long")
    small, large, spent = None, None, []
    for depth in range(LEVELS):
        level = stored(level, "paths")
        spent.append(level)
        sizes = level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        done = level.join(sizes.where(F.col("size") <= SMALL), "node").select("key", "node")
        small = done if small is None else small.union(done)
        sizes = sizes.where(F.col("size") > SMALL)
        if depth == LEVELS - 1:
            large = _in_blocks(level, sizes.select("node", F.ceil(F.col("size") / BLOCK_ROWS).cast("int").alias("n_blocks")), "node")
            break
        large = level.join(sizes.select("node"), "node")
        level = large.join(able.select("key", "sig"), "key").select("key", "node", "sig").mapInArrow(_children(0), "key long, node long").distinct()
    links = stored(small.join(sketches, "key").repartition("node").sortWithinPartitions("node").select("node", "key", "sketch").mapInArrow(_sketched, "a long, b long"), "candidates")
    packed = large.join(sketches, "key").repartition("node", "block").sortWithinPartitions("node", "block").select("node", "block", "n_blocks", "key", "sketch")
    packed = stored(packed.mapInArrow(_sketches_packed, "node long, block int, n_blocks int, keys binary, sketches binary"), "sketches")
    pairs = _by_pairs(packed, "node", _sketched_pairs, "a long, b long", "candidates")
    near = stored(connected_components(links.union(pairs)).select(F.col("node").alias("key"), F.col("component").alias("near")), "near")
    spent += [links, packed, pairs, near]

    placed = near.join(classes.select("key", "row", "copies", "n"), "key")
    sizes = stored(placed.groupBy("near").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("n_blocks")), "sizes")
    placed = _in_blocks(placed, sizes, "near").join(source.select("row", "text"), "row").select("near", "block", "n_blocks", "key", "copies", "text")
    placed = stored(placed.distinct(), "texts")  # distinct: rows may repeat as a whole
    alone = placed.where("n_blocks = 1").repartition("near").sortWithinPartitions("near").mapInArrow(_compared, "key long, links long, root long")
    compared = stored(alone, "compared")
    packed = placed.where("n_blocks > 1").repartition("near", "block").sortWithinPartitions("near", "block")
    packed = stored(packed.mapInArrow(_sets_packed, "near long, block int, n_blocks int, keys binary, copies binary, sizes binary, sets binary"), "sets")
    pairs = _by_pairs(packed, "near", _compared_pairs, "key long, links long, root long", "compared")
    spent += [sizes, placed, compared, packed, pairs]
    links = compared.union(pairs)
    groups = connected_components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = links.groupBy("key").agg(F.sum("links").alias("links"))
    grouped = classes.select("key", "rep", "copies").join(groups.withColumnRenamed("node", "key"), "key")
    named = grouped.join(grouped.groupBy("component").agg(F.min("rep").alias("class_id")), "component").select("key", "component", "class_id")
    result = stored(
        classes.select("key", "half", "key2", "rep", "copies")
        .join(links, "key", "left")
        .join(named, "key", "left")
        .select(
            F.col("half").alias("key"),
            "key2",
            F.coalesce("component", "key").alias("component"),
            F.coalesce("class_id", "rep").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "classes",
    )
    for table in (*spent, classes):
        discard(table)
    return signed.select("doc_id", "key", "key2").join(result, ["key", "key2"])


def _sketches(batches):
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        low = mix(sig.astype(np.uint64)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([x.tobytes() for x in low], pa.binary())], names=["key", "sketch"])


def _with_key(docs: DataFrame) -> DataFrame:
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("_key", T.LongType()), T.StructField("_key2", T.LongType())])

    def run(batches):
        for part in slices(batches, at):
            keys = set_keys(shingle_sets([t or "" for t in part.column(at).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=[*part.schema.names, "_key", "_key2"])

    return docs.mapInArrow(run, schema)


#: Classes of a component that are chosen among in one task at a time.
CHOSEN_ROWS = 1000


def _own_texts(t: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
    """The rows of a run whose text has their key (other rows may share the doc_id), one for each, and the shingle sets."""
    sets = [s for part in slices(t.to_batches()) for s in shingle_sets(part.column("text").to_pylist())]
    keys = np.column_stack([t.column(c).to_numpy() for c in ("key", "key2")])
    right = np.flatnonzero((set_keys(sets) == keys).all(axis=1))
    right = right[np.unique(keys[right], axis=0, return_index=True)[1]]
    return t.select(["component", "rep", "key", "key2"]).take(pa.array(right)), [sets[i] for i in right.tolist()]


def _linked(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    size, other = (np.array([len(x) for x in s], np.int64) for s in (a, b))
    both = _shared(a, b).astype(np.int64)
    return both * 5 >= 4 * (size[:, None] + other[None, :] - both)


def _chosen(batches):
    """The first classes of a component to those that stay: in order, each that none of those before it is linked with."""
    for t in _runs(batches, "component"):
        rows, sets = _own_texts(t)
        if not rows.num_rows:
            continue
        order = np.lexsort((rows.column("key2").to_numpy(), rows.column("key").to_numpy(), rows.column("rep").to_numpy()))
        rows, sets = rows.take(pa.array(order)), [sets[i] for i in order.tolist()]
        linked = _linked(sets, sets)
        gone, stay = np.zeros(len(sets), bool), []
        for i in range(len(sets)):
            if not gone[i]:
                stay.append(i)
                gone |= linked[i]
        data = [pa.array([x.tobytes()]) for x in (np.array([len(sets[i]) for i in stay], np.int64), np.concatenate([sets[i] for i in stay]))]
        names = [rows.column(c).take(pa.array(stay)).to_numpy() for c in ("rep", "key", "key2")]
        yield pa.RecordBatch.from_arrays(
            [rows.column("component")[:1].combine_chunks(), *[pa.ListArray.from_arrays(pa.array([0, len(stay)], pa.int32()), pa.array(x)) for x in names], *data],
            names=["component", "rep", "key", "key2", "sizes", "sets"],
        )


def _left_over(batches):
    """Later classes of a component, with those that stay, to the ones that none of these is linked with."""
    for t in _runs(batches, "component", "salt"):
        rows, sets = _own_texts(t)
        if not rows.num_rows:
            continue
        first = t.slice(0, 1).to_pylist()[0]
        ends = np.cumsum(np.frombuffer(first["sizes"], np.int64))[:-1]
        stay = np.split(np.frombuffer(first["sets"], np.uint64), ends)
        free = np.flatnonzero(~_linked(sets, stay).any(axis=1))
        yield pa.RecordBatch.from_arrays([rows.column(c).take(pa.array(free)).combine_chunks() for c in ("component", "rep", "key", "key2")], names=["component", "rep", "key", "key2"])


def kept_classes(docs: DataFrame, rows: DataFrame, at_once: int | None = None) -> DataFrame:
    """doc_id, key, key2 of the classes of copies that stay: in order of their smallest doc_id, each that is linked with none that stays before it.

    So every class that goes is linked with one that stays, and no two that
    stay are. A component's classes are gone through by ``CHOSEN_ROWS`` at a
    time, in one task; what stays is compared with its later classes, dealt
    over tasks, and those linked with it go before the next round. rows:
    ``_grouped``.
    """
    at_once = at_once or CHOSEN_ROWS
    classes = stored(rows.groupBy("key", "key2", "component").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "kept-classes")
    sizes = classes.groupBy("component").agg(F.count("*").alias("size"))
    alone = classes.join(sizes.where("size = 1"), "component").select(F.col("rep").alias("doc_id"), "key", "key2")
    alive = stored(classes.join(sizes.where("size > 1"), "component").select("component", "rep", "key", "key2"), "alive")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), text_or_empty().alias("text"))
    done, spent = [stored(alone, "kept")], [classes, alive]
    while alive.limit(1).count():
        order = Window.partitionBy("component").orderBy("rep", "key", "key2")
        # a limit that Spark applies before the shuffle
        first = alive.withColumn("place", F.row_number().over(order)).where(F.col("place") <= at_once).join(texts, "rep")
        # of long texts fewer, but for the very first
        size = F.sum(F.octet_length("text").cast("long") * 2).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        first = stored(first.withColumn("bytes", size).where((F.col("bytes") <= BLOCK_BYTES) | (F.col("place") == 1)).drop("bytes", "place"), "first")
        kind = "component long, rep array<long>, key array<long>, key2 array<long>, sizes binary, sets binary"
        stay = stored(first.repartition("component").sortWithinPartitions("component").mapInArrow(_chosen, kind), "stay")
        done.append(stay.select(F.explode(F.arrays_zip("rep", "key", "key2")).alias("x")).select(F.col("x.rep").alias("doc_id"), "x.key", "x.key2"))
        seen = first.select("component", "key", "key2").distinct()
        rest = alive.join(seen, ["component", "key", "key2"], "left_anti")
        salts = rest.groupBy("component").agg(F.ceil(F.count("*") / at_once).cast("int").alias("salts"))
        dealt = rest.join(salts, "component").withColumn("salt", F.pmod(F.xxhash64("key", "key2"), F.col("salts")).cast("int")).drop("salts").join(texts, "rep")
        held = stay.join(salts, "component").select("component", "sizes", "sets", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        with few_rows_a_batch(docs.sparkSession, 64):
            met = dealt.join(held, ["component", "salt"]).repartition("component", "salt").sortWithinPartitions("component", "salt")
            alive = stored(met.mapInArrow(_left_over, "component long, rep long, key long, key2 long"), "alive")
        spent += [first, alive]
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    for table in spent:
        discard(table)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies of documents that stay: in order of doc_id, each stays that is linked with none before it that does.

    Rows without a doc_id stay; of copies the smallest doc_id stays, and of
    rows that repeat it and their text one; rows of other texts with that
    doc_id don't count.
    """
    rows = _grouped(docs)
    found = stored(kept_classes(docs, rows).select("doc_id", F.col("key").alias("_key"), F.col("key2").alias("_key2")), "found")
    repeated = rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    kept = docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    if repeated:
        keys = ["doc_id", "_key", "_key2"]
        kept = _with_key(kept).join(found, keys, "left_semi").dropDuplicates(keys).drop("_key", "_key2")
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))

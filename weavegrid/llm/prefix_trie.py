"""Conversation prefix trie: succinct level-order tries, one for each shard.

Every conversation is a sequence of turns, a turn being known by 128 bits of
its role and text. Equal sequences become one, with their number and smallest
conversation. Sequences are dealt into shards by ranges of their turns, so a
shard holds what lies next to each other in order of prefixes, and a frequent
prefix is cut into as many shards as its sequences fill. In a shard numpy builds the trie in
level order: a LOUDS bitvector (a one for each child of a node, then a zero)
and an array of labels; parents are read from the bits, and values are rolled
up level by level from the last one with ``add.at``.

A node can lie in two shards only if it is a prefix of a shard's first or last
sequence. These nodes, which are all the heavy upper ones, stay open: their
own values (without those of open children) go on as at most two sequences a
shard, which are sharded and rolled up in the same way, until one shard holds
all of them; then their ids go back to their children's rows. A level has at most a
quarter as many shards as sequences, so levels are few at every size.

Defined cases: a null role or text is empty; rows without a conv_id take no
part; turns are ordered by turn, nulls first, those with the same turn by the
MD5 of role and text; rows that repeat are turns of their own; a conversation
is one row (some 60 bytes a turn, without its texts); of sequences alike in
their first ``RANGE_TURNS`` turns all lie in one shard; other columns are
ignored; no rows give no rows, not even a root.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weavegrid.llm.common import discard, few_rows_a_batch, one_row, ship, stored

LABEL_BYTES = 16
#: Turns of a shard, about, and the fewest where that makes fewer shards than there are cores.
SHARD_TURNS, SHARD_LEAST = 1 << 16, 1 << 12
#: Leading turns by which sequences are dealt: what Spark samples of a sequence, on the driver too.
RANGE_TURNS = 1024
#: Turns that a conversation takes from the first of its hundred, at most.
FAMILY, SHARED_TURNS = 100, 5


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (label, chars): the turns of every conversation in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    label = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", label.alias("label"), F.length(text).cast("long").alias("chars")).alias("own"))
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("own")).alias("own"))
    return own.select("conv_id", F.transform("own", lambda x: F.struct(x.label.alias("label"), x.chars.alias("chars"))).alias("turns"))


def families_rebuilt(convs: DataFrame) -> DataFrame:
    """``sequences`` with the first h turns taken from the conversation whose id ends the hundred: h is the id's CRC-32 modulo 6."""
    convs = stored(convs, "sequences")
    base = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, SHARED_TURNS).alias("shared"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED_TURNS + 1)).cast("int")
    rows = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": h}).join(base, "base", "left")
    none = F.slice("turns", 1, 0)
    first = F.slice(F.coalesce("shared", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(0)))
    return rows.select("conv_id", F.concat(first, rest).alias("turns"))


def _listed(batches):
    """Rows sorted by sequence and conv_id to the ids of each run in a batch, comma-joined."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, seq = batch.column("conv_id"), batch.column("seq")
        new = pc.not_equal(seq[1:], seq[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        text = [",".join(map(str, ids[a:b].to_pylist())) for a, b in zip(cuts, cuts[1:])]
        first = pa.array(cuts[:-1])
        yield pa.RecordBatch.from_arrays([seq.take(first), ids.take(first), pa.array(text, pa.string())], names=["seq", "first", "ids"])


def _hashed(batches):
    """Runs sorted by sequence and first id to the SHA-256 of all ids of a sequence; what is held is the state of the hash."""
    last, state = None, None
    for batch in batches:
        seq, out = [], []
        for s, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist()):
            if s != last:
                if state is not None:
                    seq.append(last)
                    out.append(state.hexdigest())
                last, state = s, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(seq, pa.binary()), pa.array(out, pa.string())], names=["seq", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["seq", "ends"])


def _distinct(convs: DataFrame) -> DataFrame:
    """Distinct sequences as records of the first level: path, chars, and the values of their last node."""
    path = F.unhex(F.array_join(F.transform("turns", lambda x: x.label), ""))
    rows = stored(convs.select("conv_id", path.alias("path"), F.col("turns.chars").alias("chars")).withColumn("seq", F.unhex(F.md5("path"))), "paths")
    runs = rows.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(_listed, "seq binary, first long, ids string")
    ends = runs.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(_hashed, "seq binary, ends string")
    once = rows.groupBy("seq").agg(F.first("path").alias("path"), F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("least")).join(ends, "seq")
    zero = F.array(F.lit(0).cast("long"))
    values = [F.array("n").alias("n"), F.array("least").alias("least"), zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), F.array("ends").alias("ends")]
    out = stored(once.select(F.lit(0).cast("long").alias("record"), "path", "chars", F.array(F.size("chars")).alias("at"), *values), "records")
    discard(rows)
    return out


class Louds:
    """A level-order trie as bits and labels. Node 0 is the root; ``labels[i - 1]`` leads to node i."""

    def __init__(self, bits: np.ndarray, labels: np.ndarray):
        self.bits, self.labels = bits, labels
        ones = np.flatnonzero(bits)
        #: the i-th one stands for node i + 1, and as many zeros precede it as nodes precede its parent
        self.parent = np.concatenate([[-1], ones - np.arange(len(ones))])
        zeros = np.flatnonzero(~bits)
        self.end = zeros - np.arange(len(zeros)) + 1
        self.start = np.concatenate([[1], self.end[:-1]])

    @classmethod
    def of_sorted(cls, labels: np.ndarray, sizes: np.ndarray) -> tuple[Louds, np.ndarray]:
        """The trie of sequences in order (their labels one after another, as pairs of numbers), and the node to which each label of each sequence leads."""
        start = np.cumsum(sizes) - sizes
        nodes = np.zeros(len(labels), np.int64)
        node, active = np.zeros(len(sizes), np.int64), np.arange(len(sizes))
        degrees, own, n, depth = [], [], 1, 0
        level = 1
        while True:
            active = active[sizes[active] > depth]
            at = start[active] + depth
            parent, label = node[active], labels[at]
            new = np.ones(len(active), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (label[1:] != label[:-1]).any(axis=1)
            nodes[at] = node[active] = n - 1 + np.cumsum(new)
            degrees.append(np.bincount(parent[new] - (n - level), minlength=level))
            own.append(label[new])
            level = int(new.sum())
            if not level:
                break
            n, depth = n + level, depth + 1
        degree = np.concatenate(degrees)
        bits = np.ones(len(degree) + int(degree.sum()), bool)
        bits[np.cumsum(degree + 1) - 1] = False
        return cls(bits, np.concatenate(own)), nodes

    def levels(self) -> list[tuple[int, int]]:
        """First and last + 1 of the nodes of each level."""
        out, a, b = [], 0, 1
        while a < b:
            out.append((a, b))
            a, b = b, int(self.end[b - 1])
        return out

    def find(self, labels: np.ndarray) -> int | None:
        """The node to which a sequence of labels leads."""
        node = 0
        for label in labels:
            a, b = int(self.start[node]), int(self.end[node])
            found = np.flatnonzero((self.labels[a - 1 : b - 1] == label).all(axis=1))
            if not len(found):
                return None
            node = a + int(found[0])
        return node


_VALUES = ("n", "children", "leaves", "saved")
_SHARD = (
    "shard long, bits binary, labels binary, depth array<int>, conv_id array<long>, parent array<long>, side array<int>, n array<long>, children array<long>, leaves array<long>, saved array<long>, ends array<string>, "
    "up array<struct<record:bigint,path:binary,chars:array<bigint>,at:array<int>,n:array<bigint>,least:array<bigint>,children:array<bigint>,leaves:array<bigint>,saved:array<bigint>,ends:array<string>>>, "
    "record array<long>, record_depth array<int>, record_conv array<long>, record_side array<int>"
)


def _flat(batches: list[pa.RecordBatch], column: str) -> pa.Array:
    return pa.concat_arrays([b.column(column).flatten() for b in batches])


def _rolled_up(is_last: bool, refers: bool):
    """Sorted records of a shard to its trie, the rows of its closed nodes and the records of its open ones. refers: whether records of the level before wait for their nodes' ids."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        task = TaskContext.get()
        shard = task.partitionId() if task else 0
        paths = [p for b in batches for p in b.column("path").to_pylist()]
        labels = np.frombuffer(b"".join(paths), ">u8").astype(np.uint64).reshape(-1, 2)
        sizes = np.array([len(p) // LABEL_BYTES for p in paths], np.int64)
        start = np.cumsum(sizes) - sizes
        trie, nodes = Louds.of_sorted(labels, sizes)
        parent, count = trie.parent, len(trie.parent)
        depth, chars = np.zeros(count, np.int64), np.zeros(count, np.int64)
        depth[nodes] = np.arange(len(nodes)) - np.repeat(start, sizes) + 1
        chars[nodes] = _flat(batches, "chars").to_numpy()

        def node_at(record: np.ndarray, at: np.ndarray) -> np.ndarray:
            """The nodes of records at depths."""
            return np.where(at > 0, nodes[np.maximum(start[record] + at - 1, 0)], 0) if len(nodes) else np.zeros(len(at), np.int64)

        has = np.concatenate([b.column("at").value_lengths().to_numpy() for b in batches])
        given = node_at(np.repeat(np.arange(len(paths)), has), _flat(batches, "at").to_numpy().astype(np.int64))
        value = {c: np.zeros(count, np.int64) for c in _VALUES}
        for c in _VALUES:
            np.add.at(value[c], given, _flat(batches, c).to_numpy())
        least = np.full(count, np.iinfo(np.int64).max)
        own_least = _flat(batches, "least")
        np.minimum.at(least, given, pc.fill_null(own_least, np.iinfo(np.int64).max).to_numpy())
        ends = np.full(count, None, object)
        for i, e in zip(given.tolist(), _flat(batches, "ends").to_pylist()):
            if e is not None:
                ends[i] = e

        sides = [np.concatenate([[0], nodes[start[r] : start[r] + sizes[r]]]).astype(np.int64) for r in dict.fromkeys([0, len(paths) - 1])]
        side = np.full(count, -1)
        for s in (1, 0)[2 - len(sides) :]:
            side[sides[s]] = s
        is_open = side >= 0 if not is_last else np.zeros(count, bool)
        for a, b in reversed(trie.levels()):
            closed = a + np.flatnonzero(~is_open[a:b])
            value["leaves"][closed] += value["children"][closed] == 0
            value["saved"][closed] += (value["n"][closed] - 1) * chars[closed]
            closed = closed[closed > 0]
            to = parent[closed]
            for c in ("n", "leaves", "saved"):
                np.add.at(value[c], to, value[c][closed])
            np.add.at(value["children"], to, 1)
            np.minimum.at(least, to, least[closed])

        closed = np.flatnonzero(~is_open)
        above = np.maximum(parent[closed], 0)
        known = ~is_open[above] & (closed > 0)
        names = ["shard", "bits", "labels", "depth", "conv_id", "parent", "side", *_VALUES, "ends"]
        columns = [
            pa.array([shard], pa.int64()),
            pa.array([np.packbits(trie.bits).tobytes()]),
            pa.array([trie.labels.astype(">u8").tobytes()]),
            one_row(pa.int32(), depth[closed].astype(np.int32)),
            one_row(pa.int64(), least[closed]),
            one_row(pa.int64(), least[above], ~known),
            one_row(pa.int32(), side[above].astype(np.int32), ~is_open[above] | (closed == 0)),
            *[one_row(pa.int64(), value[c][closed]) for c in _VALUES],
            one_row(pa.string(), ends[closed].tolist()),
        ]
        up = []
        for s, of in enumerate(sides if not is_last else ()):
            at = np.arange(len(of)) if s == 0 else np.flatnonzero(side[of] == s)
            own = of[at]
            up.append(
                {
                    "record": 2 * shard + s,
                    "path": paths[0 if s == 0 else -1],
                    "chars": chars[of[1:]].tolist(),
                    "at": at.tolist(),
                    "least": [x if x < np.iinfo(np.int64).max else None for x in least[own].tolist()],
                    "ends": ends[own].tolist(),
                    **{c: value[c][own].tolist() for c in _VALUES},
                }
            )
        records = np.concatenate([b.column("record").to_numpy() for b in batches])
        refer = np.repeat(np.arange(len(paths)), sizes + 1) if refers else np.zeros(0, np.int64)
        at = np.arange(len(refer)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1) if refers else refer
        to = node_at(refer, at)
        columns += [
            pa.array([up], _UP),
            one_row(pa.int64(), records[refer]),
            one_row(pa.int32(), at.astype(np.int32)),
            one_row(pa.int64(), least[to], is_open[to]),
            one_row(pa.int32(), side[to].astype(np.int32), ~is_open[to]),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "up", "record", "record_depth", "record_conv", "record_side"])

    return run


_LONGS = pa.list_(pa.int64())
_UP = pa.list_(pa.struct([("record", pa.int64()), ("path", pa.binary()), ("chars", _LONGS), ("at", pa.list_(pa.int32())), ("n", _LONGS), ("least", _LONGS), ("children", _LONGS), ("leaves", _LONGS), ("saved", _LONGS), ("ends", pa.list_(pa.string()))]))


def tries(convs: DataFrame, shard_turns: int = SHARD_TURNS, shard_least: int = SHARD_LEAST) -> list[DataFrame]:
    """Tables of shards, one for each level of records; the last has a single shard. convs: conv_id and turns."""
    spark = convs.sparkSession
    ship(spark)
    records, out = _distinct(convs), []
    while True:
        count, turns = records.agg(F.count("*"), F.coalesce(F.sum(F.size("chars") + 1), F.lit(0))).first()
        n = max(math.ceil(turns / shard_turns), min(spark.sparkContext.defaultParallelism, math.ceil(turns / shard_least)))
        n = max(1, min(n, count // 4))
        dealt = records.withColumn("range", F.substring("path", 1, LABEL_BYTES * RANGE_TURNS))
        dealt = (dealt.repartitionByRange(n, "range") if n > 1 else dealt.repartition(1)).sortWithinPartitions("path").drop("range")
        out.append(stored(dealt.mapInArrow(_rolled_up(n == 1, bool(out)), _SHARD), "tries"))
        if len(out) == 1:
            discard(records)
        if n == 1:
            return out
        records = out[-1].select(F.explode("up").alias("up")).select("up.*")


def nodes(levels: list[DataFrame]) -> DataFrame:
    """The rows of all nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    own = ["depth", "conv_id", "parent", "side", *_VALUES, "ends"]
    found, places = [], None
    for i, level in reversed(list(enumerate(levels))):
        with few_rows_a_batch(level.sparkSession, 4):
            rows = level.select("shard", F.explode(F.arrays_zip(*own)).alias("node")).select("shard", "node.*")
        if places is None:
            found.append(rows.drop("shard", "side"))
        else:
            found.append(rows.where("side is null").drop("shard", "side"))
            waiting = rows.where("side is not null").select((F.col("shard") * 2 + F.col("side")).alias("record"), (F.col("depth") - 1).alias("record_depth"), *[c for c in own if c not in ("parent", "side")])
            found.append(waiting.join(places.withColumnRenamed("record_conv", "parent"), ["record", "record_depth"]).drop("record", "record_depth"))
        if i:
            refers = level.select("shard", F.explode(F.arrays_zip("record", "record_depth", "record_conv", "record_side")).alias("r")).select("shard", "r.*")
            known = refers.where("record_side is null").select("record", "record_depth", "record_conv")
            if places is not None:
                later = refers.where("record_side is not null").select(F.col("record").alias("of"), (F.col("shard") * 2 + F.col("record_side")).alias("record"), "record_depth")
                known = known.union(later.join(places, ["record", "record_depth"]).select(F.col("of").alias("record"), "record_depth", "record_conv"))
            places = known
    rows = reduce(DataFrame.unionByName, found)
    nothing = hashlib.sha256(b"").hexdigest()
    return rows.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"),
    )


def family_trie(conversations: DataFrame) -> DataFrame:
    """Rows of the nodes of the trie of rebuilt conversations."""
    return nodes(tries(families_rebuilt(sequences(conversations))))

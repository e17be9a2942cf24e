import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from weavegrid.llm import prefix_trie
from weavegrid.llm.prefix_trie import Louds

SCHEMA = "conv_id long, turn long, role string, text string, depth string, shard int"


def ordered(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    return {c: [x[-1] for x in sorted(t)] for c, t in own.items()}


def rebuilt(rows):
    own, out = ordered(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members, ends, children = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c in sorted(convs):
        t = tuple(convs[c])
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
            if d:
                children[t[: d - 1]].add(t[:d])
        ends[t].append(c)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -(10**9), len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


def found(df):
    return sorted((r.conv_id, r.depth, -(10**9) if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(seed):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(140), *range(250, 300), -1, -100, -150, 10**12]:
        for t in range(rnd.choice([1, 2, 3, 6, 9])):
            rows.append((c, None if t == 0 and c % 7 == 0 else t, rnd.choice(["user", None]) if c % 5 else "user", rnd.choice(["a", "bé", None, "", "long " * 9]) if t else "hello", "x", 1))
    rows += [(None, 1, "user", "nobody", "x", 1), (77, 5, "user", "tie", "x", 1), (77, 5, "user", "same", "x", 1), (77, 5, "user", "same", "x", 1)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [4, 40, 1 << 16])
def test_equals_brute_force_whatever_the_shards(spark, shard_turns):
    rows = conversations(shard_turns)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    convs = rebuilt(rows)
    levels = prefix_trie.tries(prefix_trie.families_rebuilt(prefix_trie.sequences(df)), shard_turns, 1 << 20)
    assert len(levels) > 2 or shard_turns > 1000 and len(levels) == 1
    assert found(prefix_trie.nodes(levels)) == brute(convs)


def test_the_query_on_small_shards_and_turnless_conversations(spark):
    rows = [(c, t, "user", f"{t}", "x", 1) for c in range(100, 130) for t in range(c % 4)]
    rows = [r for r in rows if r[0] != 100]  # no base: short conversations lose all turns
    df = spark.createDataFrame(rows, SCHEMA)
    convs = rebuilt(rows)
    assert any(not t for t in convs.values())
    assert found(prefix_trie.family_trie(df)) == brute(convs)


def test_copies_and_a_deep_shared_prefix(spark):
    """Half of all conversations are one and the same, and many share sixty turns before they part."""
    rows = [(1000 + c, t, "user", "copy", "x", 1) for c in range(150) for t in range(5)]
    rows += [(2000 + c, t, "user", "deep" if t < 60 else f"{c % 11}", "x", 1) for c in range(60) for t in range(61 + c % 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    convs = ordered(rows)
    levels = prefix_trie.tries(prefix_trie.sequences(df), 200, 1 << 20)
    assert len(levels) > 1
    assert found(prefix_trie.nodes(levels)) == brute(convs)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert found(prefix_trie.family_trie(df)) == []
    assert found(prefix_trie.family_trie(spark.createDataFrame([(None, 0, "user", "x", "y", 1)], SCHEMA))) == []


def test_louds_of_sorted_sequences():
    words = sorted({tuple(random.Random(i).choices(range(3), k=i % 6)) for i in range(200)})
    labels = np.array([(x, 0) for w in words for x in w], np.uint64)
    trie, nodes = Louds.of_sorted(labels, np.array([len(w) for w in words]))
    prefixes = {w[:d] for w in words for d in range(len(w) + 1)}
    assert len(trie.parent) == len(prefixes) and trie.bits.sum() == len(prefixes) - 1 and (~trie.bits).sum() == len(prefixes)
    at = {p: trie.find(np.array([(x, 0) for x in p], np.uint64).reshape(-1, 2)) for p in prefixes}
    assert sorted(at.values()) == list(range(len(prefixes)))
    assert all(trie.parent[i] == at[p[:-1]] for p, i in at.items() if p)
    assert trie.find(np.array([(9, 0)], np.uint64)) is None
    own = iter(nodes.tolist())
    assert all(next(own) == at[w[: d + 1]] for w in words for d in range(len(w)))
    assert sum(b - a for a, b in trie.levels()) == len(prefixes)

import random

import pytest
from pyspark.sql import functions as F

from weavegrid.operators import consensus, graph, usage
from weavegrid.sources import tables


def vote_lines(n=3000):
    rnd = random.Random(5)
    out = []
    for _ in range(n):
        ids = rnd.sample([f"CWE-{i}" for i in range(30)], rnd.choice([1, 1, 2]))
        out.append(f'CVE-{rnd.randrange(40)},{rnd.choice([80, 90, 97, 100])},"{ids}",{rnd.randrange(50)},{rnd.choice([1, 1, 2])},0.5')
    return out


def usage_lines(n=2000):
    rnd = random.Random(6)
    return [f"CVE-{rnd.randrange(30)},{rnd.choice(['analyzer', 'critic'])},t,{rnd.randrange(99)},{i},{i},{rnd.randrange(99)}" for i in range(n)]


def layouts(spark, tmp_path, lines, header=None):
    """The same lines as one file in one split, as one file in many, and as many files."""
    head = [header] if header else []
    (tmp_path / "one").mkdir()
    (tmp_path / "one/all.csv").write_text("\n".join([*head, *lines]) + "\n")
    (tmp_path / "many").mkdir()
    step = max(1, len(lines) // 7)
    sizes = [0, *(step // 3 * i * i for i in range(1, 4)), *range(4 * step, len(lines), step), len(lines)]  # unlike sizes, which Spark packs out of order
    for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
        (tmp_path / f"many/part-{i:03}.csv").write_text("\n".join([*head, *lines[a:b]]) + "\n")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for folder, size, cost in (("one", "128m", "4m"), ("one", "3000", "0"), ("many", "128m", "0"), ("many", "2500", "10")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            yield str(tmp_path / folder)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_first_seen_and_last_written_follow_the_files(spark, tmp_path):
    lines = vote_lines()
    votes, first = {}, {}
    for i, line in enumerate(lines):
        record, _, rest = line.partition(",")
        ids = [x.strip(" '") for x in rest[rest.index("[") + 1 : rest.index("]")].split(",")]
        frequency = int(rest.split("]")[1].split(",")[2])
        for x in ids:
            votes[record, x] = votes.get((record, x), 0) + frequency
            first.setdefault((record, x), i)
    expected = {}
    for (record, x), n in votes.items():
        expected[record] = min(expected.get(record, (1, 0, "")), (-n, first[record, x], x))
    expected = {r: x for r, (_, _, x) in expected.items()}
    seen = set()
    for path in layouts(spark, tmp_path, lines):
        rows = tables.read_similarity(spark, path).withColumnRenamed("record_id", "r").withColumnRenamed("r", "record_id")
        assert {r["record_id"]: r["consensus"] for r in consensus.consensus(rows).collect()} == expected
        tiers = sorted(map(str, consensus.tiers(rows).collect()))
        seen.add(str((tiers, sorted(map(str, consensus.top_per_similarity(rows).collect())), sorted(map(str, consensus.totals(rows).collect())))))
        parts = rows.rdd.getNumPartitions()
    assert len(seen) == 1 and parts > 1


def test_last_stage_follows_the_files(spark, tmp_path):
    lines = usage_lines()
    last = {}
    for line in lines:
        record, stage, _, *numbers = line.split(",")
        last[record, stage] = [int(x) for x in numbers]
    expected = {}
    for (record, _), numbers in last.items():
        expected[record] = [a + b for a, b in zip(expected.get(record, [0] * 4), numbers)]
    header = "cve_id,stage,timestamp,input_length,input_words,output_length,output_words"
    for path in layouts(spark, tmp_path, lines, header):
        rows = usage.by_record(tables.read_usage(spark, path)).collect()
        assert {r["record_id"]: [r[f"sum_{m}"] for m in usage.MEASURES] for r in rows} == expected


def edge(a, b):
    return (str(a), str(b), "CHILDOF")


@pytest.mark.parametrize("n", [1, 37, 5000])
def test_ancestor_chains_of_any_length(spark, n):
    edges = spark.createDataFrame([edge(i, i + 1) for i in range(n)], "src string, dst string, rel_type string")
    nodes = spark.range(n + 1).select(F.col("id").cast("string").alias("id"))
    if n < 100:
        rows = {int(r.node): [int(x) for x in r.chain] for r in graph.ancestor_chain(nodes, edges).collect()}
        assert rows == {i: list(range(i + 1, n + 1)) for i in range(n)}
        return
    found = graph.ancestor_chain(nodes, edges)
    assert [tuple(r) for r in found.select(F.sum(F.size("chain")), F.count("*")).collect()] == [(n * (n + 1) // 2, n)]
    assert found.where("node = '0'").first().chain == [str(i) for i in range(1, n + 1)]


def test_ancestor_chains_with_cycles(spark):
    edges = [edge(1, 2), edge(2, 3), edge(3, 4), edge(4, 2), edge("self", "self"), edge("x", "self"), edge("a", "b"), edge("b", "a"), edge("tail", 1), edge("two", "p"), edge("two", "o"), edge("o", "gone")]
    nodes = spark.createDataFrame([(x,) for x in ["1", "2", "3", "4", "self", "x", "a", "b", "tail", "two", "o", "lonely"]], "id string")
    rows = {r.node: r.chain for r in graph.ancestor_chain(nodes, spark.createDataFrame(edges, "src string, dst string, rel_type string")).collect()}
    assert rows == {
        "1": ["2", "3", "4"], "2": ["3", "4", "2"], "3": ["4", "2", "3"], "4": ["2", "3", "4"], "self": ["self"], "x": ["self"],
        "a": ["b", "a"], "b": ["a", "b"], "tail": ["1", "2", "3", "4"], "two": ["o", "gone"], "o": ["gone"],
    }
    assert graph.ancestor_chain(nodes, spark.createDataFrame([], "src string, dst string, rel_type string")).collect() == []

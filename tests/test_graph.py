"""Traversals on a small graph with a diamond, a cycle, a parallel pair, peers, a missing end and an isolated node."""

import pytest
from pyspark.sql import functions as F

from weavegrid.operators import graph

NODES = [("P1", "Pillar"), ("C1", "Class"), ("C2", "Class"), ("B1", "Base"), ("B2", "Base"), ("B3", "Base"), ("B4", "Base"), ("V1", "Variant"), ("V2", "Variant"), ("V3", "Variant"), ("V4", "Variant"), ("X", "Base")]
EDGES = [
    ("C1", "P1", "CHILDOF"), ("C2", "P1", "CHILDOF"), ("B1", "C1", "CHILDOF"), ("B1", "C2", "CHILDOF"), ("V1", "B1", "CHILDOF"), ("V2", "B1", "CHILDOF"),
    ("B2", "B3", "CANPRECEDE"), ("B3", "B4", "CANPRECEDE"), ("B4", "B2", "CANPRECEDE"), ("B2", "V3", "REQUIRES"), ("B2", "V3", "CANPRECEDE"),
    ("V1", "V2", "PEEROF"), ("V2", "V3", "PEEROF"), ("V3", "V1", "PEEROF"), ("V4", "GONE", "CHILDOF"),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(i, f"name of {i}", k) for i, k in NODES], "id string, name string, type string")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, rel_type string")


def seed(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "seed string, node string")


def test_edges_with_a_missing_end_go(nodes, edges):
    assert graph.valid_edges(nodes, edges).count() == len(EDGES) - 1


def test_reciprocals_are_idempotent(nodes, edges):
    once = graph.with_reciprocals(edges, nodes)
    assert ("P1", "C1", "PARENTOF") in {tuple(r) for r in once.collect()}
    assert once.count() == graph.with_reciprocals(once, nodes).count()


def test_levels_are_least_and_cycles_end(spark, edges):
    found = {r["node"]: (r["level"], r["score"]) for r in graph.sequence_forward(edges, seed(spark, "B2")).collect()}
    assert found == {"B3": (1, 1.0), "V3": (1, 1.0), "B4": (2, 0.8)}
    back = {r["node"]: r["level"] for r in graph.sequence_backward(edges, seed(spark, "B2")).collect()}
    assert back == {"B4": 1, "B3": 2}


def test_explicit_seeds(spark, edges):
    found = {r["node"]: r["score"] for r in graph.explicit_seeds(edges, seed(spark, "B2")).collect()}
    assert found["B3"] == 1.0 and found["V3"] == 1.0
    assert found["V1"] == pytest.approx(0.7 * 0.8)  # a peer, one hop on


def test_ancestors(nodes, edges):
    up = {(r["node"], r["level"]): (r["ancestor"], r["score"]) for r in graph.abstraction_up(nodes, edges).collect()}
    assert up["V1", 1] == ("B1", pytest.approx(0.56)) and up["V1", 2][0] == "C1" and up["V1", 3][0] == "P1"
    chains = {r["node"]: r["chain"] for r in graph.ancestor_chain(nodes, edges).collect()}
    assert chains["V1"] == ["B1", "C1", "P1"] and "X" not in chains
    table = {tuple(r) for r in graph.abstraction_table(nodes, edges).collect()}
    assert table == {(v, "B1", c, "P1") for v in ("V1", "V2") for c in ("C1", "C2")}


def test_groups(edges):
    assert {r["node"]: r["group"] for r in graph.groups_of(edges).collect()} == {"V1": "V1", "V2": "V1", "V3": "V1"}


def test_groups_of_long_paths_take_few_rounds(spark, monkeypatch):
    import random

    rng = random.Random(3)
    names = [f"P{i}" for i in range(1500)]
    rng.shuffle(names)
    paths = [names[:600], names[600:900], *[names[i : i + 2] for i in range(900, 1500, 2)]]
    rows = [(a, b, "PEEROF") for p in paths for a, b in zip(p, p[1:])] + [("Z", "Z", "PEEROF"), (names[0], names[0], "PEEROF")]
    tables = []
    monkeypatch.setattr(graph, "kept", lambda df, kept=graph.kept: tables.append(1) or kept(df))
    found = graph.groups_of(spark.createDataFrame(rows, "src string, dst string, rel_type string"))
    assert {r["node"]: r["group"] for r in found.collect()} == {n: min(p) for p in [*paths, ["Z"]] for n in p}
    assert len(tables) < 50


def test_richness_counts_both_ways(edges):
    found = {r["id"]: (r["n_types"], r["n_relations"]) for r in graph.richness(edges).collect()}
    assert found["B2"] == (2, 4)


def test_positions(spark, edges):
    found = {r["node"]: r["position"] for r in graph.chain_positions(edges, seed(spark, "B2")).collect()}
    assert found == {"B2": "ROOT", "B3": "EFFECT", "V3": "EFFECT", "B4": "EFFECT"}


def test_combination(spark, nodes):
    rows = spark.createDataFrame([("q", "B1", "keyword_match", 1.0), ("q", "B1", "keyword_match", 0.5), ("q", "V1", "explicit_mention", 1.0), ("q", "C1", "relationship_richness", 0.05)], "query_id string, node string, strategy string, score double")
    found = {r["node"]: r["score"] for r in graph.combined(rows, nodes).collect()}
    assert found == {"B1": pytest.approx(0.8 * 1.3), "V1": pytest.approx(1.2)}  # C1 is below the floor


def test_betweenness_of_a_path(spark):
    rows = spark.createDataFrame([("a", "b", "R"), ("b", "c", "R"), ("c", "d", "R")], "src string, dst string, rel_type string")
    found = {r["node"]: r["betweenness"] for r in graph.betweenness(rows).collect()}
    assert found == {"a": 0.0, "b": pytest.approx(2 / 6), "c": pytest.approx(2 / 6), "d": 0.0}
    joined = {r["node"]: r["betweenness"] for r in graph.betweenness(rows, most_edges=2, sources_at_once=2).collect()}
    assert joined == pytest.approx(found)


def test_betweenness_by_joins_is_the_same(spark):
    import random

    rng = random.Random(7)
    links = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(34)} | {("x", "y"), ("y", "x"), ("z", "z")}
    rows = spark.createDataFrame([(a, b, "R") for a, b in sorted(links)], "src string, dst string, rel_type string")
    wanted = {r["node"]: r["betweenness"] for r in graph.betweenness(rows).collect()}
    found = {r["node"]: r["betweenness"] for r in graph.betweenness(rows, most_edges=0).collect()}
    assert sum(wanted.values()) > 0.1 and found == pytest.approx(wanted)


def brute_betweenness(links):
    """By the numbers of shortest paths between all pairs."""
    links = {(a, b) for a, b in links if a != b}
    nodes = sorted({x for e in links for x in e})
    far, paths = {}, {}
    for s in nodes:
        far[s], paths[s], level = {s: 0}, {s: 1}, [s]
        while level:
            after = []
            for v in level:
                for w in (b for a, b in links if a == v):
                    if w not in far[s]:
                        far[s][w], paths[s][w] = far[s][v] + 1, 0
                        after.append(w)
                    if far[s][w] == far[s][v] + 1:
                        paths[s][w] += paths[s][v]
            level = after
    through = lambda s, v, t: v in far[s] and t in far[v] and far[s][v] + far[v][t] == far[s][t]
    n = len(nodes)
    return {v: sum(paths[s][v] * paths[v][t] / paths[s][t] for s in nodes for t in far[s] if len({s, v, t}) == 3 and through(s, v, t)) / ((n - 1) * (n - 2) or 1) for v in nodes}


@pytest.mark.parametrize("most_edges", [0, 1000])
def test_betweenness_of_trees_on_a_directed_graph(spark, most_edges):
    import random

    rng = random.Random(5)
    links = {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(18)} | {("n0", "one-way"), ("other-way", "n1"), ("two", "of two"), ("of two", "two")}
    for i in range(26):  # trees on it and apart from it, both ways
        on = rng.choice([f"n{rng.randrange(9)}", f"t{rng.randrange(i + 1)}", f"t{i - 1}", "apart"])
        links |= {(f"t{i}", on), (on, f"t{i}")}
    rows = spark.createDataFrame([(a, b, "R") for a, b in sorted(links)], "src string, dst string, rel_type string")
    found = {r["node"]: r["betweenness"] for r in graph.betweenness(rows, most_edges=most_edges, sources_at_once=5).collect()}
    assert found == pytest.approx(brute_betweenness(links))


def test_betweenness_of_a_forest_has_no_sources(spark, monkeypatch):
    links = [(f"c{i}", f"s{i % 3}") for i in range(40)] + [(f"s{i}", f"r{i % 2}") for i in range(5)]
    links += [(b, a) for a, b in links]
    monkeypatch.setattr(graph, "_shares_by_task", lambda *a: pytest.fail("all nodes of a forest as sources"))
    rows = spark.createDataFrame([(a, b, "R") for a, b in links], "src string, dst string, rel_type string")
    found = {r["node"]: r["betweenness"] for r in graph.betweenness(rows).collect()}
    assert found == pytest.approx(brute_betweenness(links))


def test_mermaid(spark, nodes, edges):
    found, inside = graph.neighbourhood(edges, seed(spark, "C1"), ("CHILDOF",), 1)
    text = graph.mermaid(found.join(nodes.withColumnRenamed("id", "node"), "node").select("seed", F.col("node").alias("id"), "name"), inside).first()["diagram"]
    assert text.splitlines() == ["graph TD", '    B1["name of B1"]', '    C1["name of C1"]', '    P1["name of P1"]', "    B1 -->|childof| C1", "    C1 -->|childof| P1"]


def test_every_relation_with_a_reverse_gets_it(spark, sf):
    from weavegrid.plans import catalogue

    rows = {tuple(r) for r in catalogue.queries()["reciprocal_edges"](spark, sf).collect()}
    back = {"CHILDOF": "PARENTOF", "CANPRECEDE": "CANFOLLOW"}
    wanted = {(dst, src, back[rel]) for src, dst, rel in rows if rel in back}
    assert {rel for _, _, rel in wanted} == set(back.values())  # event types too, which no table of nodes has
    assert wanted <= rows

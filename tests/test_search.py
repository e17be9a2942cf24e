import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weavegrid.operators import dense, retrieval, sparse


def vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dims)).round(1)
    m[5:9] = m[n // 2]  # ties
    return m


@pytest.mark.parametrize(("n", "asked", "block", "tile"), [(40, 3, 1 << 21, 4096), (700, 30, 4096, 16)])
def test_topk_equals_brute_force(spark, monkeypatch, n, asked, block, tile):
    monkeypatch.setattr(dense, "QUERY_BLOCK", 7)
    monkeypatch.setattr(dense, "BLOCK_BYTES", block)
    monkeypatch.setattr(dense, "TILE", tile)
    m = vectors(n, 6, n)
    odd = [("none", None), ("empty", []), ("zero", [0.0] * 6), ("nan", [float("nan")] * 6), ("inf", [float("inf")] + [1.0] * 5), ("hole", [1.0, None])]
    rows = spark.createDataFrame([(f"v{i}", v.tolist(), 1) for i, v in enumerate(m)] + [(*x, 1) for x in odd], "vec_id string, embedding array<double>, query_id int").repartition(3)
    q = vectors(asked, 6, 99)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(-1, None)], "query_id long, query array<double>")
    cos = (q / np.linalg.norm(q, axis=1)[:, None]) @ (m / np.linalg.norm(m, axis=1)[:, None]).T
    for threshold in (None, 0.3):
        expected = set()
        for i in range(asked):
            best = sorted((-round(c, 6), f"v{j}") for j, c in enumerate(cos[i]) if threshold is None or c >= threshold)[:5]
            expected |= {(i, x, -s, k) for k, (s, x) in enumerate(best, 1)}
        got = {(r.query_id, r.vec_id, r.score, r["rank"]) for r in dense.topk(rows.drop("query_id"), queries, 5, threshold).collect()}
        assert got == expected
    every = dense.cosine_scores(rows.drop("query_id"), queries, None).collect()
    assert len(every) == n * asked


def test_a_top_k_moves_k_rows_a_query_and_block(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_BYTES", 8 * 6 * 50)
    m = vectors(400, 6, 1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors(4, 6, 2))], "query_id long, query array<double>")
    assert dense.block_scores(rows, queries, None, 3).count() <= 4 * 3 * 8


def test_shorter_vectors_count_as_padded(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [3.0, 4.0, 0.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0, 0.0]), ("s", [1.0])], "query_id string, query array<double>")
    got = {(r.query_id, r.vec_id, round(r.score, 9)) for r in dense.cosine_scores(rows, queries, None).collect()}
    assert got == {("q", 1, 0.6), ("q", 2, 0.6), ("s", 1, 0.6), ("s", 2, 0.6)}


def test_substrings_of_any_length(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("abAB é𝄞\n.", k=rnd.choice([0, 2, 30, 200]))) for _ in range(60)] + ["x" * 5000, "aaaa", "", None]
    asked = ["", "a", "B", "𝄞", "ab", "é𝄞", "aaa", "aaaa", "ab a", "zz", "zzzz", "a\nb", " ", ".", "xxxxxxxx", None, "ab ab é", "b é𝄞 a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    expected = {(i, j) for i, q in enumerate(asked) for j, t in enumerate(texts) if q is not None and t is not None and q.lower() in t.lower()}
    assert {(r.query_id, r.doc_id) for r in sparse.phrase_matches(docs, queries).collect()} == expected
    only = queries.where("length(text) >= 3")
    found = sparse.phrase_matches(docs, only)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert {(r.query_id, r.doc_id) for r in found.collect()} == {(i, j) for i, j in expected if len(asked[i]) >= 3}
    assert sparse.phrase_matches(docs, queries.where("text = ''")).count() == 63
    assert sparse.phrase_matches(docs, queries.limit(0)).collect() == []


NODES = [("CWE-79", "Cross-site Scripting", "Base"), ("CWE-89", "SQL Injection", "Base"), ("CWE-74", "Injection", "Class")]


def test_substrings_where_bm25_finds_nothing(spark):
    nodes = spark.createDataFrame(NODES, "id string, name string, type string")
    asked = spark.createDataFrame([(1, "script"), (2, "ject"), (3, "SQL injection"), (4, "nowhere"), (5, ""), (6, None)], "query_id long, text string")
    got = {(r.query_id, r.node, round(r.score, 3)) for r in retrieval.keyword_matches(nodes, asked).collect() if r.query_id != 3}
    assert got == {(1, "CWE-79", 1.0), (2, "CWE-74", 1.0), (2, "CWE-89", 1.0)}
    starts = asked.withColumn("phrases", F.when(F.col("query_id") == 4, F.create_map(F.lit("weakness"), F.array(F.lit("site scr")))).otherwise(F.create_map().cast("map<string,array<string>>")))
    got = {(r.query_id, r.node) for r in retrieval.starting_nodes(starts, nodes).collect()}
    assert {(1, "CWE-79"), (2, "CWE-74"), (2, "CWE-89"), (4, "CWE-79")} <= got and not {q for q, _ in got} & {5, 6}


@pytest.mark.parametrize("broken", [None, "sparse", "dense", "graph", "all"])
def test_a_failing_retriever_fails_alone(spark, monkeypatch, broken):
    nodes = spark.createDataFrame(NODES, "id string, name string, type string")
    edges = spark.createDataFrame([("CWE-79", "CWE-74", "CHILDOF"), ("CWE-89", "CWE-74", "CHILDOF")], "src string, dst string, rel_type string")
    queries = spark.createDataFrame([("q", "sql injection CWE-79")], "query_id string, text string")
    vectors = spark.createDataFrame([("CWE-79", [1.0, 0.0]), ("CWE-89", [0.8, 0.6])], "vec_id string, embedding array<double>")
    near = spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, query array<double>")

    def in_a_task(*_, **__):  # planned without complaint, fails when it runs
        rows = spark.range(1).select(F.lit("q").alias("query_id"), F.lit("x").alias("doc_id"), F.raise_error(F.lit("lost index")).cast("double").alias("score"))
        return rows.withColumnRenamed("doc_id", "vec_id" if broken == "dense" else "doc_id")

    def in_its_plan(*_, **__):
        raise OSError("no connection")

    if broken in ("sparse", "all"):
        monkeypatch.setattr(retrieval.sparse, "bm25_topk", in_a_task if broken == "sparse" else in_its_plan)
    if broken in ("dense", "all"):
        monkeypatch.setattr(retrieval.dense, "topk", in_a_task if broken == "dense" else in_its_plan)
    if broken in ("graph", "all"):
        monkeypatch.setattr(retrieval, "graph_hits", in_its_plan)
    out = retrieval.searched(queries, retrieval.node_text(nodes), vectors, near, nodes, edges)
    failed = {r.retriever: (r.kind, r.message) for r in out.errors().collect()}
    kinds = {r.retriever for r in out.all().select("retriever").distinct().collect()}
    lost = {"sparse", "dense", "graph"} if broken == "all" else {broken} - {None}
    assert set(failed) == lost and kinds == {"sparse", "dense", "graph"} - lost
    if broken in ("sparse", "dense"):
        assert "lost index" in failed[broken][1]
    if broken == "all":
        assert failed["sparse"] == ("OSError", "no connection")
        assert out.all().schema.simpleString() == "struct<query_id:string,entry_id:string,retriever:string,score:double>"

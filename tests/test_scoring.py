"""Scores against published or hand-made values."""

import math

import pytest
from pyspark.sql import functions as F

from weavegrid.functions.config import RETRIEVAL, SCORING, checked_weights, shifted_weights
from weavegrid.functions.scoring import normalized
from weavegrid.operators import dense, fusion, sparse


def fused(spark, hits, entries, **kw):
    h = spark.createDataFrame(hits, "query_id string, entry_id string, retriever string, score double")
    e = spark.createDataFrame(entries, "entry_id string, abstraction string, usage string, n_relations int")
    return {r["entry_id"]: r for r in fusion.fuse(h, e, **kw).collect()}


def test_golden_from_normalised_scores(spark):
    hits = [("q", "258", "dense", 0.7756104082235742), ("q", "258", "sparse", 0.5262846631104398 * 1250), ("q", "258", "graph", 0.5746733943916607 * 2.8)]
    row = fused(spark, hits, [("258", "Variant", "Allowed", 0)])["258"]
    weighted = 0.35 * 0.7756104082235742 + 0.4 * 0.5262846631104398 + 0.25 * 0.5746733943916607
    assert math.isclose(row["weighted"] * 1.2 * 1.1, 0.8258525308708515, rel_tol=1e-14)
    assert math.isclose(row["weighted"], weighted, rel_tol=1e-14)
    assert row["score"] == round(0.8258525308708515, 6)


def test_golden_from_raw_scores(spark):
    row = fused(spark, [("q", "917", "dense", 0.505), ("q", "917", "sparse", 1060.911), ("q", "917", "graph", 0.477)], [("917", "Base", "Allowed", 0)])["917"]
    assert row["score"] == pytest.approx(0.7991281, abs=1e-6)
    assert row["dense_pct"] + row["sparse_pct"] + row["graph_pct"] == pytest.approx(100)


def test_bonus_only_for_what_the_graph_alone_found(spark):
    rows = fused(spark, [("q", "1", "graph", 1.4), ("q", "2", "graph", 1.4), ("q", "2", "sparse", 0.0)], [("1", "Compound", None, 9), ("2", "Compound", None, 9)])
    assert rows["1"]["relationship_bonus"] == 1.45 and rows["2"]["relationship_bonus"] == 1.0


def test_modes(spark):
    hits = [("q", "1", "dense", 0.9), ("q", "2", "sparse", 100.0)]
    entries = [("1", "Base", "Allowed", 0)]
    assert set(fused(spark, hits, entries)) == {"1", "2"}
    assert set(fused(spark, hits, entries, mode="sparse_gated")) == {"2"}
    with pytest.raises(ValueError):
        fused(spark, hits, entries, mode="other")


def test_shared_scoring_raises_what_several_found(spark):
    hits = [("q", "1", "dense", 0.5), ("q", "1", "sparse", 625.0), ("q", "2", "dense", 0.5)]
    plain, shared = fused(spark, hits, [("1", "x", "x", 0)]), fused(spark, hits, [("1", "x", "x", 0)], scoring="shared")
    assert shared["1"]["score"] == pytest.approx(plain["1"]["score"] * 1.5, abs=1e-5)
    assert shared["2"]["score"] == plain["2"]["score"]


def test_normalised_at_most_one(spark):
    rows = spark.createDataFrame([("sparse", 5000.0), ("graph", 1.4), ("dense", 1.5), ("sparse", -3.0)], "r string, s double")
    assert [r[0] for r in rows.select(normalized(F.col("r"), F.col("s"))).collect()] == [1.0, 0.5, 1.0, -3 / 1250]


def test_weights():
    checked_weights(SCORING.retriever_weights)
    with pytest.raises(ValueError):
        checked_weights({"dense": 0.9, "sparse": 0.9})
    moved = shifted_weights(SCORING.retriever_weights, True)
    assert moved["sparse"] == pytest.approx(0.55) and sum(moved.values()) == pytest.approx(1)
    assert shifted_weights(SCORING.retriever_weights, False) == SCORING.retriever_weights


def bm25(docs, query):
    """Plain Python, all documents."""
    words = {d: t.lower().split() for d, t in docs.items()}
    n, avgdl = len(docs), sum(map(len, words.values())) / len(docs)
    df = {}
    for w in words.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    return {d: sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avgdl)) for t in query.lower().split() if t in w) for d, w in words.items()}


def test_bm25_small_corpus(spark):
    docs = {1: "a b c a", 2: "a c d", 3: "a b", 4: "e f a c", 5: ""}
    frame = spark.createDataFrame(list(docs.items()), "doc_id int, text string")
    asked = spark.createDataFrame([(1, "a b b"), (2, "zzz"), (3, "E c")], "query_id int, text string")
    found = {(r["query_id"], r["doc_id"]): r["score"] for r in sparse.bm25_scores(frame, asked).collect()}
    for q, text in ((1, "a b b"), (3, "E c")):
        for d, s in bm25(docs, text).items():
            assert found.get((q, d), 0.0) == pytest.approx(s, abs=1e-12)
    assert not [k for k in found if k[0] == 2]


def test_phrase_variants_and_boost(spark):
    docs = spark.createDataFrame([(1, "buffer overflow in parser"), (2, "parser crash"), (3, "nothing here"), (4, "more text"), (5, "some other words")], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "parser", {"rootcause": ["overflow", "buffer"], "weakness": ["crash"]})], "query_id int, text string, phrases map<string,array<string>>")
    assert {r["source"] for r in sparse.query_variants(asked).collect()} == {"base", "rootcause", "rootcause_1", "weakness"}
    found = {r["doc_id"]: r for r in sparse.boosted_search(docs, asked, 5).collect()}
    assert found[1]["boosted"] and "rootcause_1" in found[1]["sources"]


def test_dense_threshold_and_ties(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.0])], "vec_id int, embedding array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, query array<double>")
    rows = dense.topk(vectors, asked, 3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in rows] == [(1, 1.0), (2, 1.0), (4, 0.707107)]
    assert RETRIEVAL.dense_threshold == 0.3

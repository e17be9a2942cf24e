import pytest
from pyspark.sql import functions as F

from weavegrid.functions import config
from weavegrid.functions import text as tx
from weavegrid.operators import evaluate, reports, retrieval

NODES = [("CWE-1", "buffer overflow", "Base"), ("CWE-2", "buffer reading past the end", "Variant"), ("CWE-3", "sql injection", "Class"), ("CWE-4", "path traversal", "Base"), ("CWE-5", "race condition", "Base")]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, "id string, name string, type string")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("CWE-2", "CWE-1", "CHILDOF"), ("CWE-1", "CWE-5", "CANPRECEDE"), ("CWE-3", "CWE-4", "PEEROF")], "src string, dst string, rel_type string")


def test_starting_nodes(spark, nodes):
    asked = spark.createDataFrame([("a", "see CWE-3 and CWE-99", {}), ("b", "anything", {"rootcause": ["race condition"]}), ("c", "path traversal in zip", {})], "query_id string, text string, phrases map<string,array<string>>")
    found = {(r[0], r[1]) for r in retrieval.starting_nodes(asked, nodes).collect()}
    assert found == {("a", "CWE-3"), ("b", "CWE-5"), ("c", "CWE-4")}
    seeds = {(r["query_id"], r["node"]): r["score"] for r in retrieval.chain_seeds(asked, nodes).collect()}
    assert seeds == {("b", "CWE-5"): 0.8}


def test_search_joins_retrievers(spark, nodes, edges):
    asked = spark.createDataFrame([("q", "buffer overflow")], "query_id string, text string")
    vectors = spark.createDataFrame([("CWE-3", [1.0, 0.0]), ("CWE-4", [0.0, 1.0])], "vec_id string, embedding array<float>")
    near = spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, query array<double>")
    rows = retrieval.search(asked, retrieval.node_text(nodes), vectors, near, nodes, edges, 5).collect()
    found = {(r["retriever"], r["entry_id"]) for r in rows}
    assert {("sparse", "CWE-1"), ("dense", "CWE-3"), ("graph", "CWE-5"), ("graph", "CWE-4")} <= found


def test_fallback(spark, nodes):
    asked = spark.createDataFrame([("q", "short"), ("r", "one two three four five six seven")], "query_id string, text string")
    docs = nodes.union(spark.createDataFrame([("X", "so One two three four five six seven!", "Base")], nodes.schema))
    assert [(r["query_id"], r["node"], r["score"]) for r in retrieval.substring_fallback(asked, docs, 5).collect()] == [("r", "X", 1.0)]


def test_prompts(spark, nodes, edges):
    records = spark.createDataFrame([("r", "what", {"weakness": ["a", "b"]}, "x", None, "z")], "record_id string, description string, phrases map<string,array<string>>, analysis string, criticism string, resolution string")
    votes = spark.createDataFrame([("r", "CWE-1")], "record_id string, consensus string")
    table = reports.result_table(spark.createDataFrame([("r", 1, "CWE-1", "n", 0.5)], "query_id string, rank int, entry_id string, name string, score double"))
    relations = reports.relationship_text(edges, nodes).select(F.lit("r").alias("record_id"), "relations").limit(1)
    prompt = reports.enhanced_query(records, votes, table, relations).first()["prompt"]
    assert "## Keyphrases\nweakness: a and b" in prompt and "| 1 | CWE-1 | n | 0.5000 |" in prompt
    report = reports.final_report(records).first()["report"]
    assert "## Criticism\nnone" in report and "- weakness: a, b" in report
    assert reports.as_json(records).first()["json"].startswith('{"record_id":"r"')


def test_summaries(spark):
    merged = spark.createDataFrame([("r", ["1", "2"], [], [], ["3"])], "record_id string, primary array<string>, secondary array<string>, tertiary array<string>, contributing array<string>")
    similar = spark.createDataFrame([("r", "1", ["1", "9"]), ("s", None, [])], "record_id string, consensus string, top array<string>")
    fused = spark.createDataFrame([("r", "3", 1, 0.9), ("r", "8", 2, 0.1)], "query_id string, entry_id string, rank int, score double")
    agents = spark.createDataFrame([("r", "critic", "2", 0.5)], "record_id string, agent string, entry_id string, confidence double")
    row = {r["record_id"]: r for r in evaluate.summary_rows(merged, similar, fused, agents).collect()}
    assert [(e["entry_id"], e["class"]) for e in row["r"]["entries"]] == [("3", "contributing"), ("8", "unknown")]
    assert row["r"]["agents"]["critic"][0]["entry_id"] == "2" and row["s"]["primary"] is None
    text = reports.summary_report(merged.join(similar, "record_id")).first()["report"]
    assert "1 records, 1 with a consensus" in text and "## primary\n- 1: 1\n- 2: 1" in text
    sources = {(r["source"], r["entry_id"]) for r in reports.ids_by_source(merged, similar, fused.withColumn("retriever", F.lit("dense")), agents).collect()}
    assert sources == {("primary", "1"), ("primary", "2"), ("contributing", "3"), ("consensus", "1"), ("top_similar", "1"), ("top_similar", "9"), ("retriever_dense", "3"), ("retriever_dense", "8"), ("agent_critic", "2")}


def test_small_reports(spark):
    advice = spark.createDataFrame([("r", "child", "a", 0.9), ("r", "child", "b", 0.5), ("r", "peer", "c", 0.5)], "record_id string, role string, other string, relevance double")
    assert reports.reasoning(advice).first()["text"] == "2 entries are each a child\n1 entry is a peer"
    chains = spark.createDataFrame([("r", "a>b", 0)], "record_id string, chain string, pos int")
    said = reports.enriched_response(spark.createDataFrame([("r", "hi"), ("s", "yo")], "record_id string, response string"), advice, chains)
    assert {r["record_id"]: r["response"] for r in said.collect()} == {"r": "hi\n- more specific: a\n- more specific: b\n- alternative: c\n- chain: a>b", "s": "yo"}
    stages = spark.createDataFrame([("critic", 2, 1.5, 2.0)], "stage string, n long, avg_input_words double, avg_output_words double")
    assert [r["line"] for r in reports.usage_report(stages).collect()][-1] == "| critic | 2 | 1.50 | 2.00 |"
    a = spark.createDataFrame([("r", ["1"]), ("s", ["2"])], "record_id string, ids array<string>")
    b = spark.createDataFrame([("r", ["3", "1"])], "record_id string, ids array<string>")
    assert {r["record_id"]: r["ids"] for r in evaluate.prior_ids(a, b).collect()} == {"r": ["1", "3"], "s": ["2"]}
    hits = spark.createDataFrame([("q", "a", 0.1), ("q", "b", 0.7), ("q", None, 1.0), ("q", "a", 0.9)], "query_id string, entry_id string, score double")
    assert evaluate.detected_ids(hits).first()["ids"] == ["a", "b"]
    top = evaluate.top_as_primary(spark.createDataFrame([("r", i, str(i)) for i in range(1, 6)], "record_id string, rank int, entry_id string"))
    assert top.count() == 3


def test_validity(spark):
    rows = spark.createDataFrame([("ok",), ("",), (None,), ("x" * 20,)], "t string").select(tx.validity(F.col("t"), 10))
    assert [r[0] for r in rows.collect()] == [None, "empty", "empty", "too long"]


def test_configuration(tmp_path):
    scoring, retrieval = config.configured({"weights": {"dense": 0.5, "sparse": 0.25, "graph": 0.25}, "retrieval": {"k": 3}})
    assert scoring.retriever_weights["dense"] == 0.5 and retrieval.k == 3
    for bad in ({"weights": {"dense": 2.0}}, {"other": 1}):
        with pytest.raises(ValueError):
            config.configured(bad)
    (tmp_path / "t.md").write_text("hi")
    assert config.template(str(tmp_path / "t.md")) == "hi"

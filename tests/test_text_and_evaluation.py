import pytest
from pyspark.sql import functions as F

from weavegrid.functions import hooks
from weavegrid.functions import text as tx
from weavegrid.operators import consensus, evaluate, sparse, usage


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw, wanted", [("79", "CWE-79"), ("cwe 79", "CWE-79"), (" CWE-79 ", "CWE-79"), ("x79", None), (None, None)])
def test_canonical_id(spark, raw, wanted):
    assert one(spark, tx.canonical_id, raw) == wanted


def test_ids_in_text(spark):
    text = "CWE-20, cwe125 then CWE 20 and CWE-125"
    assert one(spark, tx.ids_in, text) == ["CWE-20", "CWE-125"]
    assert one(spark, lambda c: tx.ids_in(c, "strict"), text) == ["CWE-20", "CWE-125"]
    assert one(spark, tx.ids_in, None) == []


def test_paths(spark):
    assert one(spark, tx.record_path, "CVE-2021-1047") == "2021/1xxx/CVE-2021-1047"
    assert one(spark, tx.record_id_in, "/a/CVE-2021-0674_analysis.md") == "CVE-2021-0674"


def test_phrases(spark):
    found = one(spark, tx.search_phrases, {"rootcause": [" a ", "", None], "weakness": ["  "], "impact": ["x"]}, "map<string,array<string>>")
    assert found == {"rootcause": ["a"]}
    assert one(spark, tx.joined_phrase, ["a", " ", "b"], "array<string>") == "a and b"
    assert one(spark, lambda c: tx.phrase_in(c, "rootcause"), "Weakness: w, RootCause:  bad check\nmore") == "bad check"
    assert one(spark, tx.pairs_map, "a:1,b:2") == {"a": "1", "b": "2"}


@pytest.mark.parametrize("text, wanted", [("85%", 0.85), ("0.9", 0.9), ("high", None), (None, None), ("1", 1.0)])
def test_confidence(spark, text, wanted):
    assert one(spark, tx.confidence, text) == wanted


def test_small_texts(spark):
    assert one(spark, lambda c: tx.highlighted(c, F.lit("b")), "abc") == "a**b**c"
    assert one(spark, lambda c: tx.highlighted(c, F.lit("")), "abc") == "abc"
    assert one(spark, lambda c: tx.shortened(c, 5, 2), "abcdef") == "ab..."
    assert one(spark, tx.without_fences, "```markdown\nhi\n```") == "hi"
    assert one(spark, tx.word_count, "  a\tb \n") == 2 and one(spark, tx.word_count, None) == 0
    assert one(spark, tx.tokens, "A-b c_1 É") == ["a", "b", "c_1", "é"]


AGENT = """# Analysis
| CWE ID | CWE Name | Confidence | CWE Vulnerability Mapping Label | CWE-Vulnerability Mapping Notes |
|---|---|---|:--:|---|
| CWE-20 | Input | 85% | Primary | Allowed |
| CWE-125 | Read | 0.6 | Secondary candidate | |
| CWE-77 | Cmd | | | contributing |

CWE-999 outside."""


def test_tables(spark):
    docs = spark.createDataFrame([("CVE-1", AGENT), ("CVE-2", "no table: CWE-1 and secondary CWE-2")], "doc_id string, text string")
    found = {r["entry_id"]: (r["class"], r["confidence"]) for r in evaluate.table_answers(docs).collect()}
    assert found == {"CWE-20": ("primary", 0.85), "CWE-125": ("secondary", 0.6), "CWE-77": ("contributing", None)}
    text = [tuple(r) for r in evaluate.text_answers(docs.where("doc_id = 'CVE-2'")).collect()]
    assert text == [("CVE-2", 0, "CWE-1", "secondary"), ("CVE-2", 1, "CWE-2", "secondary")]


def test_segments_and_kinds(spark):
    assert one(spark, evaluate.segments, "# A\nx\n# B\ny") == ["# A\nx\n", "# B\ny"]
    assert one(spark, evaluate.segments, "plain") == ["plain"]
    assert one(spark, evaluate.document_kind, "CVE-1_criticism.md") == "criticism"


def test_merge_keeps_order(spark):
    rows = spark.createDataFrame([("r", 1, 0, "primary", "b"), ("r", 0, 1, "primary", "a"), ("r", 0, 0, "primary", "b"), ("r", 0, 0, "tertiary", "c")], "record_id string, file int, pos int, class string, entry_id string")
    row = evaluate.merged_answers(rows).first()
    assert (row["primary"], row["secondary"], row["tertiary"]) == (["b", "a"], [], ["c"])


def test_comparison(spark):
    given = spark.createDataFrame([("a", ["1", "2"]), ("b", ["3"]), ("c", ["9"])], "record_id string, ids array<string>")
    truth = spark.createDataFrame([("a", ["2", "4"]), ("b", ["5"])], "record_id string, ids array<string>")
    rows = evaluate.compared(given, truth)
    assert {r["record_id"]: (r["in_truth"], r["matched"], r["truth_only"], r["results_only"]) for r in rows.collect()} == {
        "a": (True, ["2"], ["4"], ["1"]), "b": (True, [], ["5"], ["3"]), "c": (False, [], [], ["9"])}
    summary = evaluate.comparison_summary(rows).first()
    assert (summary["n_in_truth"], summary["n_matching"], float(summary["match_pct"])) == (2, 1, 50.0)
    empty = evaluate.comparison_summary(rows.where("false")).first()
    assert empty["n_records"] == 0 and empty["coverage_pct"] is None
    assert "matched: **2**" in evaluate.comparison_report(rows.where("record_id = 'a'")).first()["report"]


def test_consensus(spark):
    rows = [("r", 97, ["a"], 2, 10, 0), ("r", 97, ["b", "a"], 1, 99, 1), ("r", 88, ["b"], 2, 5, 2), ("r", 80, [], 7, 5, 3), ("s", 90, ["x"], 1, 1, 4), ("s", 90, ["y"], 1, 1, 5)]
    votes = spark.createDataFrame(rows, "record_id string, similarity int, ids array<string>, frequency int, total int, pos long")
    assert {r["record_id"]: (r["consensus"], r["votes"]) for r in consensus.consensus(votes).collect()} == {"r": ("a", 3), "s": ("x", 1)}
    tiers = {r["record_id"]: (r["high"], r["medium"], r["low"]) for r in consensus.tiers(votes).collect()}
    assert tiers["r"] == (["a", "b"], ["b"], [])
    assert {r["record_id"]: r["total"] for r in consensus.totals(votes).collect()} == {"r": 20, "s": 1}
    top = [(r["similarity"], r["rank"], r["entry_id"]) for r in consensus.top_per_similarity(votes).where("record_id = 'r'").orderBy("similarity", "rank").collect()]
    assert top == [(88, 1, "b"), (97, 1, "a"), (97, 2, "b")]


def test_usage(spark):
    rows = [("r", "analyzer", 0, 10, 3, 20, 6), ("r", "analyzer", 1, 30, 9, 40, 12), ("r", "critic", 2, 5, 1, 5, 1), ("s", "critic", 3, 7, 2, 9, 3)]
    log = spark.createDataFrame(rows, "record_id string, stage string, pos int, input_length int, input_words int, output_length int, output_words int")
    record = {r["record_id"]: r for r in usage.by_record(log).collect()}
    assert record["r"]["sum_input_words"] == 10 and record["r"]["stages"] == 2  # the last analyzer row counts
    levels = usage.all_levels(log).collect()
    assert len(levels) == 2 + 2 + 1
    priced = usage.priced(usage.by_record(log)).where("record_id = 'r'").first()
    assert priced["input_tokens"] == int(10 / 0.75) and priced["cost"] == pytest.approx(10 / 0.75 / 1000 * 0.0001 + 13 / 0.75 / 1000 * 0.0004)
    assert usage.by_stage(log.where("false")).count() == 0


def test_rates_guard_zero(spark):
    row = evaluate.rates(spark.createDataFrame([(0, 0, 0, 5)], "tp int, fp int, fn int, tn int")).first()
    assert row["precision"] is None and row["recall"] is None and row["accuracy"] == 1.0


def test_tfidf_prefers_the_like(spark):
    pairs = spark.createDataFrame([(1, None, "buffer overflow parser"), (1, 1, "overflow of a buffer"), (1, 2, "unrelated text entirely")], "query_id int, doc_id int, text string")
    assert [r["doc_id"] for r in sparse.tfidf_relevance(pairs).collect()] == [1]


def test_hooks(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "id int, text string")
    v = {r["id"]: r["embedding"] for r in hooks.embedded(rows).collect()}
    assert sum(x * x for x in v[1]) == pytest.approx(1) and set(v[2]) == {0.0}
    records = spark.createDataFrame([("r", "what happened", "| CWE-1 |")], "record_id string, description string, candidates string")
    row = hooks.debate(records).first()
    assert row["resolution"].startswith("You are the resolver.") and row["analysis"].startswith("You are the analyzer.")


def test_searchable_text_leaves_blank_sections_out(spark):
    rows = spark.createDataFrame([("79", "XSS", "", [("t", "d")])], "id string, name string, description string, terms array<struct<Term:string,Description:string>>")
    entry = {"id": F.col("id"), "name": F.col("name"), "description": F.col("description"), "terms": F.col("terms")}
    assert rows.select(tx.searchable_text(entry)).first()[0] == "CWE-79: XSS\n\nAlternative Terms:\n\nt - d"




def test_workers_hold_the_words_of_few_documents_at_once(spark, monkeypatch):
    from weavegrid.operators import sparse

    def sizes(batches, counted=sparse._counted):
        for batch in batches:
            assert batch.num_rows <= 64
            yield from counted([batch])

    monkeypatch.setattr(sparse, "_counted", sizes)
    docs = spark.range(0, 500, 1, 1).selectExpr("id as doc_id", "'a b a' as text")
    held = sparse.postings(docs)
    assert held.where("term = 'a' and tf = 2 and dl = 3").count() == held.where("term is null").count() == 500


def test_merged_metadata_shuffles_by_record_only_in_tasks_of_bounded_rows(spark, sf):
    import re

    from weavegrid.plans import catalogue

    rows = spark.range(1000).withColumnRenamed("id", "record_id")
    assert evaluate.by_record(rows, 100).rdd.getNumPartitions() == 10
    plan = catalogue.queries()["merged_metadata"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange [a-zA-Z].*?, ([A-Z_]+), \[plan_id", plan)
    assert dealt and set(dealt) == {"REPARTITION_BY_NUM"}

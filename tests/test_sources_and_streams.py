import json

import pytest
from pyspark.sql import functions as F

from weavegrid.sources import sinks, tables
from weavegrid.streaming import events


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


ENTRY = {"ID": "79", "Name": "n", "Abstraction": "Base", "Status": "Stable", "Description": "d", "Unknown": 1}


def test_entries(spark, tmp_path):
    full = ENTRY | {
        "MappingNotes": {"Usage": "Allowed", "Rationale": "r", "Reasons": "one", "Suggestions": [{"CweID": "20", "Comment": "c"}]},
        "PotentialMitigations": [{"Phase": ["A", "B"], "Description": "x"}, {"Phase": "C"}],
        "RelatedWeaknesses": [{"Nature": "ChildOf", "CweID": "80", "ViewID": "1000"}, {"Nature": "PeerOf", "CweID": "404", "ViewID": "1000"}],
    }
    bad = {k: v for k, v in ENTRY.items() if k != "Name"}
    path = put(tmp_path / "kb.json", json.dumps({"Weaknesses": [full, ENTRY | {"ID": "80"}, bad]}))
    good, rejected = tables.read_entries(spark, path)
    assert good.count() == 2 and rejected.count() == 1
    row = good.where("ID = '79'").first()
    assert row["MappingNotes"]["Reasons"] == ["one"] and row["MappingNotes"]["Suggestions"][0]["CweID"] == "CWE-20"
    assert [m["Phase"] for m in row["PotentialMitigations"]] == [["A", "B"], ["C"]]
    assert [tuple(r)[:3] for r in tables.entry_edges(good).collect()] == [("CWE-79", "CWE-80", "CHILDOF")]
    sinks.write_graph(tables.entry_nodes(good), tables.entry_edges(good), str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph/nodes")).count() == 2


def test_records(spark, tmp_path):
    put(tmp_path / "2021/0xxx/CVE-2021-0674.json", json.dumps({"description": "x", "keyphrases": {"rootcause": "a", "weakness": ["b", "c"]}}))
    put(tmp_path / "2021/1xxx/CVE-2021-1047.json", json.dumps({"keyphrases": None}))
    put(tmp_path / "2021/1xxx/CVE-2021-1047/refined/refined.md", "whole\ntext")
    rows = {r["record_id"]: r for r in tables.read_records(spark, str(tmp_path)).collect()}
    assert rows["CVE-2021-0674"]["phrases"] == {"rootcause": ["a"], "weakness": ["b", "c"]}
    assert rows["CVE-2021-1047"]["description"] == "" and rows["CVE-2021-1047"]["phrases"] == {}
    docs = tables.read_documents(spark, str(tmp_path), "refined.md")
    joined = tables.record_context(tables.read_records(spark, str(tmp_path)), docs)
    assert {r["record_id"]: r["reference"] for r in joined.collect()} == {"CVE-2021-0674": None, "CVE-2021-1047": "whole\ntext"}


def test_csv_sources(spark, tmp_path):
    votes = put(tmp_path / "votes.csv", "CVE-1,97,\"['CWE-1', 'CWE-2']\",9,2,0.5\nCVE-1,90,oops,9,2,0.5\n")
    assert [r["ids"] for r in tables.read_similarity(spark, votes).orderBy("pos").collect()] == [["CWE-1", "CWE-2"], []]
    truth = put(tmp_path / "truth.csv", "cve,NEW CWE,other\nCVE-1,CWE-2,x\nCVE-1,CWE-1,x\nCVE-2,NVD-CWE-noinfo,x\n")
    assert {r["record_id"]: r["ids"] for r in tables.read_truth(spark, truth).collect()} == {"CVE-1": ["CWE-1", "CWE-2"]}
    with pytest.raises(ValueError, match="absent"):
        tables.read_csv_with(spark, truth, ["CVE", "absent"])
    log = put(tmp_path / "usage.csv", "cve_id,stage,timestamp,input_length,input_words,output_length,output_words\nCVE-1,critic,t,1,2,3,4\n")
    assert tables.read_usage(spark, log).first()["output_words"] == 4
    results = put(tmp_path / "results.json", json.dumps({"CVE-1": {"primary": ["CWE-1"]}}))
    assert tables.read_results(spark, results, "struct<primary:array<string>>").first()["value"]["primary"] == ["CWE-1"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("CVE-1", ["a", "b"], 1.234, 1), ("x", [], 2.0, 9)], "record_id string, ids array<string>, seconds double, rank int")
    sinks.write_csv(rows, str(tmp_path / "c"))
    sinks.write_csv(rows, str(tmp_path / "c"), append=True)
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 4
    sinks.write_json(rows, str(tmp_path / "j"), by="record_id")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    summary = sinks.run_summary(rows, spark.createDataFrame([("bad",)], "record_id string"))
    assert [tuple(r) for r in summary.collect()] == [("CVE-1", "a|b", "1.23"), ("x", "", "2.00"), ("bad", "ERROR", "0.00")]
    sinks.write_markdown(spark.createDataFrame([("t", "b")], "title string, body string"), str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m"), wholetext=True).first()[0].startswith("# t\n\nb")
    assert sinks.needs_reload(spark, str(tmp_path / "none"), 5)
    rows.write.parquet(str(tmp_path / "p"))
    assert not sinks.needs_reload(spark, str(tmp_path / "p"), 2) and sinks.needs_reload(spark, str(tmp_path / "p"), 100)
    sinks.reset(spark, str(tmp_path / "p"))
    assert not (tmp_path / "p").exists()


def test_benchmark_columns(spark):
    results = spark.createDataFrame([("CVE-2", "primary_cwes", "CWE-9"), ("CVE-2", "primary_cwes", "CWE-1"), ("CVE-2", "primary_cwes", "CWE-1"), ("CVE-2", "consensus_cwe", ""), ("CVE-2", "retrievers", "CWE-7"), ("CVE-1", "primary_cwes", None)], "record_id string, source string, entry_id string")
    truth = spark.createDataFrame([("CVE-2", "CWE-7"), ("CVE-2", "CWE-1"), ("CVE-3", "CWE-5")], "record_id string, entry_id string")
    rows = [r.asDict() for r in sinks.benchmark_csv(results, truth).collect()]
    assert [r["CVE"] for r in rows] == ["CVE-1", "CVE-2"] and len(rows[0]) == 13
    assert set(rows[0].values()) == {"CVE-1", ""}
    held = {c: v for c, v in rows[1].items() if v}
    assert held == {"CVE": "CVE-2", "Benchmark_CWEs": "CWE-1;CWE-7", "Primary_CWEs": "CWE-1;CWE-9", "Matched_CWEs": "CWE-1;CWE-7"}
    assert sinks.benchmark_csv(results.limit(0), truth).count() == 0


def test_stream_equals_batch(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = events.tumbling(stream, watermark="3650 days").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["start"], r["event_type"], r["n"]) for r in spark.table("tumbled").collect()}
    assert got == {(r["start"], r["event_type"], r["n"]) for r in events.tumbling(rows).collect()}


def test_context_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(u, i) for u in (1, 2) for i in range(8)], "user_id long, event_id long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = events.last_n_stream(stream, "user_id", "event_id", 5).writeStream.format("memory").queryName("contexts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["user_id"]: r["context"] for r in spark.table("contexts").collect()} == {1: [3, 4, 5, 6, 7], 2: [3, 4, 5, 6, 7]}


def test_failed_batches_are_set_aside(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id long, text string").write.parquet(str(tmp_path / "in"))

    def fails(batch):
        raise RuntimeError("no")

    q = events.process_records(spark, str(tmp_path / "in"), "id long, text string", fails, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/rejected")).first()["error"] == "no"


def test_last_values_of_a_stream_are_the_last_not_the_largest(spark, tmp_path):
    source = str(tmp_path / "in")
    for start in (100, 1):
        spark.createDataFrame([(1, start + i) for i in range(3)], "k long, v long").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k long, v long").parquet(source)
        q = events.last_n_stream(stream, "k", "v", 3).writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r["context"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [[1, 2, 3], [100, 101, 102]]


def test_only_failed_records_are_set_aside(spark, tmp_path):
    spark.createDataFrame([(i, "7" if i != 5 else "bad") for i in range(8)], "id long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    process = lambda batch: batch.selectExpr("id", "cast(text as int) as n")  # noqa: E731  (ANSI mode: a bad number raises)
    q = events.process_records(spark, str(tmp_path / "in"), "id long, text string", process, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "out/rejected")).collect()] == [5]
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out/processed")).collect()) == [0, 1, 2, 3, 4, 6, 7]


@pytest.mark.parametrize(("ttl", "made"), [(3600, 1), (0, 2)])
def test_contexts_are_made_once_until_their_time(spark, tmp_path, request, ttl, made):
    def make(key):
        import time

        return f"{key} at {time.time_ns()}"

    source = str(tmp_path / "in")
    no_data = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(no_data, "false")
    request.addfinalizer(lambda: spark.conf.unset(no_data))
    for keys in (["a", "b", "a"], ["a", "c"]):
        spark.createDataFrame([(k,) for k in keys], "k string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string").parquet(source)
        q = events.remembered_stream(stream, "k", make, ttl or 1).writeStream.foreachBatch(lambda b, i: b.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        if not ttl:
            import time

            time.sleep(1.1)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["k"], r["n"]) for r in found.groupBy("k").agg(F.countDistinct("context").alias("n")).collect()} == {("a", made), ("b", 1), ("c", 1)}
    assert found.where("k = 'a'").count() == 2

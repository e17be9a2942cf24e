import json
import shutil

import pytest
from pyspark.sql import functions as F

from weavegrid.functions import hooks
from weavegrid.operators import memo, nested, usage
from weavegrid.sources import versions
from weavegrid.streaming import usage_log


def test_readers_see_the_old_or_the_new_version(spark, tmp_path):
    path = str(tmp_path / "kb")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path, "nodes")
    assert versions.needs_load(spark, path, "nodes", 5)
    tables = lambda n: {"nodes": spark.range(n), "edges": spark.range(2 * n)}
    assert versions.load(spark, path, tables(5))["rows"] == {"nodes": 5, "edges": 10}
    reader = versions.read(spark, path, "nodes")
    failing = tables(7) | {"edges": spark.range(3).select(F.raise_error(F.lit("disk full")).alias("id"))}
    with pytest.raises(Exception, match="disk full"):
        versions.load(spark, path, failing)
    assert versions.read(spark, path, "nodes").count() == 5 and versions.read(spark, path, "edges").count() == 10
    versions.load(spark, path, tables(100))
    assert reader.count() == 5  # begun before the switch
    assert versions.read(spark, path, "nodes").count() == 100 and versions.read(spark, path, "edges").count() == 200
    assert not versions.needs_load(spark, path, "nodes", 95) and versions.needs_load(spark, path, "nodes", 90) and versions.needs_load(spark, path, "other", 1)
    versions.load(spark, path, tables(3))
    folders = [p.name for p in (tmp_path / "kb").iterdir() if p.is_dir()]
    assert len(folders) == 2  # this version and the one before; the failed load's folder has gone


def test_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return {"nodes": spark.range(4)}

    for _ in range(2):
        assert versions.loaded_once(spark, str(tmp_path / "g"), build, ("nodes",))["nodes"].count() == 4
    assert len(built) == 1


HEADER = "cve_id,stage,timestamp,input_length,input_words,output_length,output_words"


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([HEADER, *lines]) + "\n")


def usage_lines(a, b):
    return [f"CVE-{i % 7},{('analyzer', 'critic', 'resolver')[i % 3]},2024-01-01T00:{i % 60:02}:00,{i},{i + 1},{i + 2},{i + 3}" for i in range(a, b)]


def totals(df):
    return sorted(map(str, usage.by_stage(df).collect()))


def test_the_log_of_a_stream_equals_the_batch_after_a_replay(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), tmp_path / "state"
    run = lambda: usage_log.append(usage_log.usage_stream(spark, str(source), "2 days", 1), out, str(state)).awaitTermination(200)
    put(source, "a.csv", usage_lines(0, 40))
    put(source, "b.csv", [*usage_lines(40, 80), *usage_lines(10, 30)])  # some delivered again
    run()
    last = max(int(p.name) for p in (state / "commits").iterdir() if p.name.isdigit())
    before = usage_log.appended(spark, out).count()
    for name in (str(last), f".{last}.crc"):
        (state / "commits" / name).unlink()  # as if the driver had been lost after it wrote its batch
    run()
    assert usage_log.appended(spark, out).count() == before == 80
    put(source, "c.csv", [*usage_lines(80, 100), *usage_lines(0, 100)])
    run()
    put(tmp_path / "all", "all.csv", usage_lines(0, 100))
    batch = spark.read.option("header", True).schema("record_id string, stage string, timestamp timestamp, input_length int, input_words int, output_length int, output_words int").csv(str(tmp_path / "all"))
    assert totals(usage_log.appended(spark, out)) == totals(batch)


def test_totals_as_state(spark, tmp_path):
    source, path, state = tmp_path / "in", str(tmp_path / "totals"), str(tmp_path / "state")
    for i in range(3):
        put(source, f"{i}.csv", usage_lines(20 * i, 20 * i + 25))  # five of each are in the next file too
        usage_log.keep_totals(usage_log.usage_stream(spark, str(source), "2 days"), path, state).awaitTermination(200)
    put(tmp_path / "all", "all.csv", usage_lines(0, 65))
    batch = spark.read.option("header", True).schema("record_id string, stage string, timestamp timestamp, input_length int, input_words int, output_length int, output_words int").csv(str(tmp_path / "all"))
    assert sorted(map(str, versions.read(spark, path, "by_stage").drop("batch_id").collect())) == totals(batch)


def recording(folder):
    def model(prompts):
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
            f.write("\n".join(prompts))
        if any("bad" in p for p in prompts):
            raise RuntimeError("refused")
        return [f"about {p}" for p in prompts]

    return model


def test_a_second_run_asks_for_new_contents_only(spark, tmp_path):
    path, calls = str(tmp_path / "memo"), tmp_path / "calls"
    rows = lambda *contents: spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "id long, content string")

    def run(*contents, capacity=100):
        shutil.rmtree(calls, ignore_errors=True)
        out, counts = memo.remembered(rows(*contents), path, model=recording(str(calls)), capacity=capacity)
        asked = {p for f in calls.iterdir() for p in f.read_text().split("\n")} if calls.exists() else set()
        return {r.id: (r.context, r.error) for r in out.collect()}, counts, asked

    out, counts, asked = run("a", "b", "a", None)
    assert out == {0: ("about a", None), 1: ("about b", None), 2: ("about a", None), 3: ("about ", None)}
    assert counts == {"found": 0, "made": 3, "failed": 0, "evicted": 0} and asked == {"a", "b", ""}
    out, counts, asked = run("b", "c", "bad")
    assert out[0] == ("about b", None) and out[1] == ("about c", None) and out[2] == (None, "RuntimeError: refused")
    assert counts == {"found": 1, "made": 1, "failed": 1, "evicted": 0} and asked == {"c", "bad"}
    assert run("b", "c", "a")[2] == set()
    out, counts, asked = run("bad", "d", capacity=3)  # of a, b, c, "" and d the last used three stay
    assert asked == {"bad", "d"} and counts["evicted"] == 2
    assert run("d")[2] == set()
    left = {r.context for r in versions.read(spark, path, memo.TABLE).collect()}
    assert "about d" in left and len(left) == 3 and "about " not in left


def test_a_run_that_fails_leaves_the_memo(spark, tmp_path):
    path = str(tmp_path / "memo")
    rows = spark.createDataFrame([("a",)], "content string")
    memo.remembered(rows, path)
    with pytest.raises(Exception, match="boom"):
        memo.remembered(rows.select(F.raise_error(F.lit("boom")).cast("string").alias("content")), path)
    assert versions.read(spark, path, memo.TABLE).count() == 1


RESULTS = {
    "CVE-1": {
        "primary_cwes": ["CWE-1", 5, None], "secondary_cwes": "CWE-9", "consensus_cwe": "CWE-2",
        "top_similar_cwes": ["CWE-3", ["CWE-4", [["CWE-5", {"cwe_id": "CWE-6", "other": ["CWE-99"]}], {"cwe_id": 7}]], {"cwe_id": "NVD-1"}, None, "x"],
        "retrievers": [
            {"cwe_id": "CWE-10", "normalized_scores": {"dense": 0.5, "sparse": None}},
            {"cwe_id": "CWE-11", "normalized_scores": {"graph": 0}}, {"cwe_id": "CWE-12"}, {"normalized_scores": {"dense": 1}}, {"cwe_id": ""},
        ],
        "agents": {"CWE-20": {"resolution": {"name": "x"}, "analysis": {"name": ""}}, "CWE-21": {"criticism": {"name": "y"}}, "CWE-22": None},
    },
    "CVE-2": {"top_similar_cwes": "CWE-30", "retrievers": None, "agents": [], "consensus_cwe": None},
    "CVE-3": None,
}


def test_ids_of_nested_results(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.json").write_text(json.dumps(RESULTS))
    (tmp_path / "r/b.json").write_text(json.dumps([{"cve_id": "CVE-4", "top_similar_cwes": [[[["CWE-40"]]]]}, {"primary_cwes": ["CWE-41"]}, "CWE-42", 7]))
    (tmp_path / "r/c.json").write_text('{"CVE-5": {"primary_cwes": [')
    (tmp_path / "r/d.json").write_text('"CWE-50"')
    got = {}
    for r in nested.ids_by_source(nested.read_results(spark, str(tmp_path / "r"))).collect():
        got.setdefault((r.record_id, r.source), set()).add(r.entry_id)
    assert got == {
        ("CVE-1", "primary_cwes"): {"CWE-1"}, ("CVE-1", "consensus_cwe"): {"CWE-2"},
        ("CVE-1", "top_similar_cwes"): {"CWE-3", "CWE-4", "CWE-5", "CWE-6"},
        ("CVE-1", "retrievers"): {"CWE-10", "CWE-11", "CWE-12"}, ("CVE-1", "retriever_dense"): {"CWE-10"}, ("CVE-1", "retriever_graph"): {"CWE-11"},
        ("CVE-1", "agents_resolution"): {"CWE-20"}, ("CVE-1", "agents_criticism"): {"CWE-21"}, ("CVE-4", "top_similar_cwes"): {"CWE-40"},
    }


def test_one_bad_prompt_fails_no_task(spark):
    seen = []

    def model(prompts):
        seen.append(len(prompts))
        if "bad" in prompts:
            raise RuntimeError("refused")
        return [p.upper() for p in prompts]

    assert hooks.isolated_answers(model, ["a", "b", "bad", "c", "d"], attempts=2) == [("A", None), ("B", None), (None, "RuntimeError: refused"), ("C", None), ("D", None)]
    assert seen == [5, 2, 3, 1, 1, 2]
    assert hooks.isolated_answers(lambda p: [], ["x"]) == [(None, "ValueError: 0 answers to 1 prompts")]
    rows = spark.createDataFrame([(i, "bad" if i == 5 else f"p{i}") for i in range(20)] + [(20, None)], "id long, prompt string")
    out = {r.id: (r.answer, r.error) for r in hooks.answered(rows, model).collect()}
    assert out[5] == (None, "RuntimeError: refused") and out[20] == ("", None)
    assert all(out[i] == (f"P{i}", None) for i in range(20) if i != 5)


def test_a_model_that_answers_the_second_time(spark):
    tries = {}

    def model(prompts):
        tries[prompts[0]] = tries.get(prompts[0], 0) + 1
        if tries[prompts[0]] < 3:
            raise OSError("busy")
        return prompts

    assert hooks.isolated_answers(model, ["x"], attempts=3) == [("x", None)]


def test_providers(spark):
    hooks.register("Shouting", hooks.Provider(lambda s: lambda p: [x + s["mark"] * s["n"] for x in p], {"mark": "!", "n": 1}))
    assert hooks.model_of("SHOUTING", {"n": 2})(["a"]) == ["a!!"] and hooks.model_of("shouting", offline=True)(["a"]) == ["a [1]"]
    with pytest.raises(ValueError, match="unknown provider 'none'"):
        hooks.model_of("none")
    rows = spark.createDataFrame([("a",)], "prompt string")
    assert hooks.answered(rows, hooks.model_of("shouting")).first().answer == "a!"

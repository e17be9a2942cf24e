"""The queries against their SQL, and the pipeline against its stages' promises."""

import pytest

import corpus_pipeline
from weavegrid.llm import packing, queries, secrets

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(name, spark, sf, duck):
    found = queries.queries()[name](spark, sf).toArrow()
    assert found.num_rows
    if name not in SQL:
        return
    wanted = duck.sql(SQL[name]).to_arrow_table()
    columns = sorted(found.column_names)
    assert columns == sorted(wanted.column_names)
    get = lambda t: sorted(map(repr, zip(*[t.column(c).to_pylist() for c in columns])))
    assert get(found) == get(wanted)


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["toxicity", "line_dedup", "ngram_jaccard_join", "secret_scans", "best_fit_packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, sf)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "best_fit_packing":
            assert out.columns == columns
            assert {r[0] for r in out.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
        if name == "secret_scans":
            assert out.count() == before.count()
            assert secrets.digest(secrets.scan(out)).where("n_assign + n_access + n_hex > 0").count() == 0
        if name == "best_fit_packing":
            wanted = packing.tokenized(before, *queries.byte_bpe())
            assert out.select(wanted.columns).exceptAll(wanted).count() == 0 == wanted.exceptAll(out.select(wanted.columns)).count()
        before = out
    assert corpus_pipeline.run(spark, sf).count() == before.count()


def odd_documents(spark):
    long = " ".join(f"word{i}" for i in range(60_000)) + "\n" * 1_100_000 + "end"
    rows = [(None, None, None, 1, "a"), (None, "no id here, but a text", 22, 1, "a"), (1, None, 0, 2, None), (2, "", 0, 2, None), (3, long, len(long), 3, "x"), (4, "the same words stand in here", 28, 4, "y"), (4, "the same words stand in here", 28, 4, "y"), (5, "user: bob\npassword: hunter22", 27, 5, "z"), (6, "the same words stand in here", 28, 6, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, n_dropped int, component string")


def test_pipeline_on_odd_rows(spark, sf):
    """Nulls, empty and very long texts, ties, repeated rows and clashing column names, through all stages; and no rows at all."""
    docs = odd_documents(spark)
    empty = docs.where("doc_id = -5")
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = stage(spark, docs, sf), stage(spark, empty, sf)
        assert empty.count() == 0
        if name != "best_fit_packing":
            rows = [r.asDict() for r in docs.collect()]
            docs = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
            assert docs.columns == ["doc_id", "text", "n_chars", "n_dropped", "component"]
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in rows) == [(0, 1), (0, 1), (1, 2), (3, 3), (4, 4), (5, 5)]
    texts = {(r["doc_id"], r["n_chars"]): r["text"] for r in rows}
    assert texts[5, 21] == "[IDENTIFIER]\n[SECRET]"
    assert max(len(t or "") for t in texts.values()) > 1_500_000
    packed = docs.collect()
    assert sum(r["piece"] == 0 for r in packed) == 6
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed)


def test_which_documents_the_pipeline_keeps(spark, sf):
    """Against a plain version of each stage's rule, on clean texts with planted cases."""
    import random

    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = line(60)
    rows = {i: "\n".join(line(12) for _ in range(8)) for i in range(60)}
    rows[60], rows[61] = rows[3], rows[4] + " w1"  # a copy and a near copy
    rows[62], rows[63] = line(90) + "\n" + passage, line(90) + "\n" + passage
    for i in range(20, 26):
        rows[i] += "\nAll rights reserved by nobody at all"
    far = 10**9  # no label has such a doc_id
    docs = spark.createDataFrame([(far + i, t) for i, t in rows.items()], "doc_id long, text string")
    wanted = {i: t for i, t in rows.items() if i not in (60, 61)}
    wanted[63] = rows[63].split("\n")[0]
    for i in range(21, 26):
        wanted[i] = "\n".join(rows[i].split("\n")[:-1])
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame([tuple(r) for r in stage(spark, docs, sf).collect()], docs.schema)
    assert {r["doc_id"] - far: r["text"] for r in docs.collect()} == wanted

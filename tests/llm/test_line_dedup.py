import numpy as np
import pytest

import corpus_pipeline
from weavegrid.llm import line_dedup, queries
from weavegrid.llm.line_dedup import Lines, agreeing, deduplicated, shared_templates

SCHEMA = "doc_id long, text string, n_chars int, dropped string"


def run(spark, texts, **kw):
    docs = spark.createDataFrame([(i, t, len(t or ""), "mine") for i, t in texts], SCHEMA)
    out = deduplicated(docs, **kw)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    return sorted((r["doc_id"] is not None, r["doc_id"], r["text"], r["n_dropped"], r["n_chars"]) for r in out.where("doc_id is not null").collect())


def test_recurring_lines_stay_once(spark):
    foot = "All rights reserved by the owner"
    got = run(spark, [(i, f"unique line number {'abc'[i % 3] * (i + 1)} here {i}x\n{foot}\nlast words {chr(97 + i)} of text") for i in range(5)])
    assert [foot in g[2] for g in got] == [True, False, False, False, False]
    assert all(g[4] == len(g[2]) for g in got)


def test_variable_fields_share_a_template(spark):
    lines = ["2024-01-02 login of alice at the gate from host7", "2023-11-30 login of bob at the gate from host9", "2022-02-02 login of carol at the gate from host1"]
    got = run(spark, [(i, f"{line}\nbody {'xyz'[i]} of this text") for i, line in enumerate(lines)])
    assert [g[3] for g in got] == [0, 1, 1]


def test_long_passages_with_small_edits(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    texts = []
    for i in range(4):
        w = list(words)
        w[20 + i] = "edited"
        texts.append((i, "start\n" + " ".join(w) + "\nend"))
    assert [g[3] for g in run(spark, texts)] == [0, 1, 1, 1]


def test_unlike_lines_stay(spark):
    got = run(spark, [(i, f"the same three {' '.join(chr(97 + (i * 7 + j * j) % 26) * 3 for j in range(6))}") for i in range(6)])
    assert all(g[3] == 0 for g in got)


def test_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, "a b\na b"), (5, "a b"), (6, "a b"), (7, "x y z w\n" * 50_000), (8, "x y z w"), (8, "x y z w"), (None, "x y z w")]
    got = run(spark, rows)
    assert [g[3] for g in got if g[1] in (7, 8)] == [0, 0, 0]  # two documents are too few
    assert [g[2] for g in got if g[1] in (4, 5, 6)] == ["a b\na b", "a b", "a b"]
    assert run(spark, []) == []


def test_repeats_within_a_document_dont_recur(spark):
    assert [g[3] for g in run(spark, [(1, "one two three four\n" * 9), (2, "other words are here")])] == [0, 0]


def brute(texts, min_tokens, min_docs=3):
    """doc_id to the line numbers that go, by comparing every two lines of a leaf with plain loops."""
    lines = {}
    for i, t in texts:
        if i is None:
            continue
        for j, line in enumerate((t or "").split("\n")):
            w = line.split()
            if len(w) >= max(min_tokens, 1):
                shape = tuple(None if any(c.isdigit() for c in x) else x for x in w)
                if sum(x is not None for x in shape) * 2 < len(w):
                    shape = ("as it stands", *w)
                lines.setdefault(shape, {}).setdefault(i, set()).add(j)
    leaves = {}
    for shape in lines:
        exact = shape[0] == "as it stands"
        leaves.setdefault(shape if exact else (len(shape), shape[:3]), []).append(shape)
    gone = {}
    for members in leaves.values():
        for u in members:
            docs = set()
            for v in members:
                same = [a for a, b in zip(u, v) if a == b]
                if u == v or len(u) - len(same) <= len(u) // 4 and 2 * sum(a is not None for a in same) >= len(u):
                    docs |= lines[v].keys()
            if len(docs) >= min_docs:
                for i, at in lines[u].items():
                    if i != min(docs):
                        gone.setdefault(i, set()).update(at)
    twice = {}
    for i, t in texts:
        for j, line in enumerate((t or "").split("\n")) if i is not None else ():
            if len(w := tuple(line.split())) >= 20:
                twice.setdefault(w, {}).setdefault(i, set()).add(j)
    for own in twice.values():
        for i, at in own.items():
            if i != min(own):
                gone.setdefault(i, set()).update(at)
    return gone


def lost(texts, rows):
    """doc_id to the numbers of lines that went, from what is left; lines that are equal go together."""
    out = {}
    for i, text, n_dropped in rows:
        kept, own = text.split("\n"), texts[i].split("\n")
        at, gone = 0, set()
        for j, line in enumerate(own):
            if at < len(kept) and kept[at] == line:
                at += 1
            else:
                gone.add(j)
        assert len(gone) == n_dropped or text == ""
        if n_dropped:
            out[i] = gone if text or n_dropped < len(own) else set(range(len(own)))
    return out


@pytest.mark.parametrize(("bucket", "pivots"), [(1024, 64), (4, 2)])
def test_equals_brute_force_both_ways(spark, sf, monkeypatch, bucket, pivots):
    """What recurs goes and what doesn't stays, on whole documents, whatever the size of buckets."""
    monkeypatch.setattr(line_dedup, "BUCKET", bucket)
    monkeypatch.setattr(line_dedup, "PIVOTS", pivots)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for min_tokens in (3, 1):
        rows = [(r["doc_id"], r["text"] or "", r["n_dropped"]) for r in deduplicated(docs, min_tokens=min_tokens).collect()]
        expected = brute(list(texts.items()), min_tokens)
        assert expected and lost(texts, rows) == expected


def varied(rng, n):
    """Eleven tokens, three fixed, eight from small sets: a leaf of lines of which some agree by chance."""
    words = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    weight = np.arange(1, 26) ** -1.3
    return ["all of it " + " ".join(words[i] for i in row) for row in rng.choice(25, (n, 8), p=weight / weight.sum())]


@pytest.mark.parametrize(("bucket", "pivots"), [(1024, 64), (200, 16), (20, 4)])
def test_one_leaf_whatever_the_size_of_buckets(spark, monkeypatch, bucket, pivots):
    monkeypatch.setattr(line_dedup, "BUCKET", bucket)
    monkeypatch.setattr(line_dedup, "PIVOTS", pivots)
    lines = varied(np.random.default_rng(8), 1500)
    texts = [(i, "\n".join(lines[5 * i : 5 * i + 5])) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = [(r["doc_id"], r["text"], r["n_dropped"]) for r in deduplicated(docs).collect()]
    gone = brute(texts, 3)
    assert lost(dict(texts), rows) == gone and 100 < sum(map(len, gone.values())) < 1400


def test_a_large_leaf_doesnt_meet_in_one_task(spark):
    """100,000 varied lines of one leaf, with buckets of three sizes: the same documents of each."""
    rng = np.random.default_rng(9)
    vectors = np.concatenate([np.tile([7, 8, 9], (100_000, 1)), rng.integers(1, 40, (100_000, 8))], axis=1).astype(np.uint16)
    vectors = np.unique(vectors, axis=0)
    rows = [(1, i, v.tobytes(), [int(i)]) for i, v in enumerate(vectors)]
    distinct = spark.createDataFrame(rows, "leaf long, line long, tokens binary, docs array<long>").repartition(4)
    found = [sorted((r.line, r.docs[0], len(r.docs)) for r in shared_templates(distinct, bucket=b, pivots=p).collect()) for b, p in ((2000, 64), (200, 16))]
    assert found[0] == found[1] and sum(n > 1 for *_, n in found[0]) > 30


def test_thousands_of_near_copies_of_a_long_line(spark):
    rng = np.random.default_rng(10)
    base = rng.integers(1, 65536, 80)
    vectors = np.tile(base, (3000, 1)).astype(np.uint16)
    for i in range(3000):
        vectors[i, rng.integers(3, 80, 4)] = rng.integers(1, 65536, 4)
    rows = [(1, i, v.tobytes(), [i]) for i, v in enumerate(vectors)] + [(1, 9000 + i, np.concatenate([base[:3], rng.integers(1, 65536, 77)]).astype(np.uint16).tobytes(), [i]) for i in range(40)]
    distinct = spark.createDataFrame(rows, "leaf long, line long, tokens binary, docs array<long>")
    got = {r.line: (r.docs[0], len(r.docs)) for r in shared_templates(distinct, bucket=100, pivots=8).collect()}
    assert all(got[i] == (0, 3) for i in range(3000)) and all(got[9000 + i] == (i, 1) for i in range(40))


def test_agreement_of_two_lines():
    v = lambda *x: np.array([x], np.uint16)
    assert agreeing(v(1, 2, 3, 4), v(1, 2, 3, 9)).all() and not agreeing(v(1, 2, 3, 4), v(1, 2, 8, 9)).any()
    assert not agreeing(v(1, 2, 0, 0, 0, 0), v(1, 2, 0, 0, 0, 7)).any()  # variable places are no evidence
    assert agreeing(v(1, 2, 3, 0, 0, 0), v(1, 2, 3, 0, 0, 7)).all()


def test_digits_are_variable():
    a, b, c = (Lines([t]) for t in ("user 12 logged in", "user 999 logged in", "user x logged in"))
    assert a.hash[0] == b.hash[0] != c.hash[0] and a.leaf[0] == b.leaf[0]


def test_large_leaves_go_deeper(spark, monkeypatch):
    """Alike lines still meet when their leaf is split into buckets."""
    monkeypatch.setattr(line_dedup, "BUCKET", 5)
    monkeypatch.setattr(line_dedup, "PIVOTS", 3)
    other = lambda i: "a b c " + " ".join(f"{chr(97 + (i * k) % 26)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for k in range(1, 8))
    rows = [(i, f"{other(i)}\na b c the line that all of these share") for i in range(40)]
    assert [g[3] for g in run(spark, rows)] == [0] + [1] * 39


def test_large_leaves_merge_lines_that_vary_early(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BUCKET", 2)
    monkeypatch.setattr(line_dedup, "PIVOTS", 3)
    other = lambda i: "a b c " + " ".join(f"{chr(97 + (i * k) % 26)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for k in range(1, 9))
    alike = {0: "red", 20: "green", 40: "blue", 59: "grey"}
    rows = [(i, other(i) + (f"\na b c {alike[i]} the line that all of these share" if i in alike else "")) for i in range(60)]
    assert [g[3] for g in run(spark, rows)] == [int(i in (20, 40, 59)) for i in range(60)]


def test_short_lines_recur_in_queries(spark, tmp_path):
    texts = ["Les.\nAnd ornd.\nalpha of one", "Les.\nbeta of two\nAnd ornd.", "gamma\nLes.", "Les.\nAnd ornd.\ndelta", ""]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["kept_text"] for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: texts[0], 1: "beta of two", 2: "gamma", 3: "delta", 4: ""}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert {r["text"] for r in corpus_pipeline.drop_recurring_lines(spark, docs, "").collect()} == {*got.values()}


def test_lines_of_numbers_recur_only_as_they_stand(spark):
    rows = [(i, f"{i} {i * 7} {i + 30}\nrow {i} {i * 3} {i + 9}\nsame 1 2 3") for i in range(1, 6)]
    got = run(spark, rows)
    assert [g[3] for g in got] == [0, 1, 1, 1, 1]
    assert all(g[2].startswith(t.rsplit("\n", 1)[0]) for g, (_, t) in zip(got, rows))


def test_long_lines_recur_in_two_documents(spark):
    words = [f"w{chr(97 + i)}" for i in range(25)]
    long, own = " ".join(words), [" ".join(f"{c}{chr(97 + i)}" for i in range(25)) for c in "xyz"]
    rows = [(1, f"{own[0]}\n{long}"), (2, f"{own[1]}\n{long}\nab cd ef"), (3, f"{own[2]} 1\nab cd ef"), (4, f"{own[2]} 2"), (5, own[0] + "\n" + long)]
    assert [g[3] for g in run(spark, rows)] == [0, 1, 0, 0, 2]
    docs = spark.createDataFrame(rows[:2] + [(6, own[1] + "\nzz yy")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in deduplicated(docs, leave_copies=True).collect()}
    assert got == {1: 0, 2: 1, 6: 0}

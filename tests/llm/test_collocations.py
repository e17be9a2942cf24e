import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from weavegrid.llm import collocations


def brute(docs, min_count, longest=4, first=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) >= 2 and a >= min_count}
    longer = collections.Counter()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], a)
    rows = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if 100 * longer[lang, p] >= 80 * a:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, p[:j]] + f[lang, p[j:]]), j, f[lang, p[:j]], f[lang, p[j:]]) for j in range(1, len(p)))
        rows[lang].append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:first], 1))


def texts(seed):
    rnd = random.Random(seed)
    words = ["a", "B", "é", "ñu", "C3", "d-e", " f", "ÀB", "the"]
    out = []
    for _ in range(60):
        n = rnd.choice([0, 1, 3, 40, 400])
        out.append((rnd.choice(["en", "fr", None, "und"]), "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ".", ", ", "\n", "\r\n"]) for _ in range(n))))
    return [*out, ("en", None), ("en", ""), ("fr", "...  ;"), (None, "x" * 5000 + " " + "y z " * 500), *[("en", "new york city hall is new york")] * 12]


@pytest.mark.parametrize("shard_words", [16, 300, 1 << 21])
def test_equals_brute_force_whatever_the_shards(spark, shard_words, monkeypatch):
    docs = texts(shard_words)
    df = spark.createDataFrame([(i, x, t, "z") for i, (x, t) in enumerate(docs)], "doc_id long, lang string, text string, n string").repartition(3)
    rows = collocations.collocations(df, min_count=10, shard_words=shard_words).collect()
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows)
    assert got == brute(docs, 10) and got


def test_first_of_lang_by_bytes_of_ties(spark):
    docs = [("en", f"{x} {y}") for x in "abzé" for y in "αbz"] * 3
    df = spark.createDataFrame(docs, "lang string, text string")
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df, first=5, min_count=3).collect())
    assert got == brute(docs, 3, first=5) and len(got) == 5


def test_a_very_common_phrase_and_one_very_long_piece(spark):
    docs = [("en", "of the " * 30000), *[("en", "of the")] * 3000, ("en", "of the " * 5000 + ". in the end")]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df, min_count=1, shard_words=4000).collect())
    assert got == brute(docs, 1)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", None)], "lang string, text string")).count() == 0


def test_chunks_never_cut_a_word():
    data = b"abc de, f" + b"x" * 40 + b" g.h" + b"y" * 25
    for size in range(2, 60):
        parts = list(collocations._chunks(data, size))
        assert b"".join(parts) == data
        assert all(p[:1] in b" ,." for p in parts[1:])
        assert all(len(p) <= size or not re.search(rb"\w[ ,.]", p[1:]) for p in parts)


def test_lists_hold_every_occurrence(spark):
    df = spark.createDataFrame([("en", "a b a b, a b c")], "lang string, text string")
    totals, found = collocations.phrases(df, min_count=1)
    assert [tuple(r) for r in totals.collect()] == [("en", 7)]
    assert {r.phrase: r.f for r in found.where(F.col("k") == 2).collect()} == {"a b": 3, "b a": 1, "b c": 1}
    assert {r.phrase: (r.heads, r.tails) for r in found.where(F.col("k") == 3).collect()}["a b c"] == ([3, 3, 1], [1, 1, 1])


def test_files_of_lists_hold_few_rows(spark):
    from weavegrid.llm.common import discard, stored

    table = stored(spark.range(0, 100, 1, 1), "few", rows_a_file=32)
    per_file = table.selectExpr("input_file_name() as f").groupBy("f").count().collect()
    assert sorted(r["count"] for r in per_file) == [4, 32, 32, 32]
    discard(table)


def test_frequent_phrases_go_back_to_shards_packed():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    shard = np.repeat(np.array([3, 4096, 8193]), 400)
    number = np.concatenate([np.sort(rng.choice(500_000, 400, replace=False)) for _ in range(3)]).astype(np.int32)
    ids = rng.integers(0, 1 << 44, 1200)
    (rows,) = collocations._packed_frequent([pa.RecordBatch.from_arrays([pa.array(shard), pa.array(number), pa.array(ids)], names=["shard", "number", "id"])])
    assert rows.column("shard").to_pylist() == [3, 4096, 8193]
    unpacked = [np.concatenate([f(collocations._from_planes(d.as_py(), k)) for d in rows.column(c)]) for c, k, f in (("numbers", "<i4", np.cumsum), ("ids", "<i8", np.asarray))]
    assert (unpacked[0] == number).all() and (unpacked[1] == ids).all()
    sent = sum(len(pa.compress(d.as_py(), "lz4", asbytes=True)) for c in ("numbers", "ids") for d in rows.column(c))
    assert sent < 10 * len(ids)  # the values of a narrow row are 20 bytes

"""Against plain Python; Spark's xxhash64 is XXH64 with each column's hash as the next one's seed."""

import hashlib
import struct

import xxhash
from pyspark.sql import functions as F

from weavegrid.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, bins string"
MASK = 2**64 - 1


def xx(*values, seed=42):
    for v in values:
        data = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - 2**64 if seed >= 2**63 else seed


def chained(values):
    h = 42
    for v in values:
        h = xx(v, seed=h & MASK)
    return h


def plain(text):
    words = [w for w in __import__("re").split(r"[ \t\n\x0b\f\r]+", text or "") if w]
    h = [xx(w) for w in words]
    s = [chained(h[i : i + 5]) for i in range(len(h) - 4)] or ([chained(h)] if h else [xx("")])
    least = {}
    for x in sorted(s):
        least.setdefault((x & MASK) >> 57, x)
    out = []
    for j in range(128):
        if j in least:
            out.append(least[j] & 255)
        else:
            out.append(min((chained([j, b]) & ~255) | (x & 255) for b, x in least.items()) & 255)
    return out


def likeness(a, b):
    same = sum(x == y for x, y in zip(a, b)) / 128
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def expected(rows):
    rows = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], xx(r[1] or "")))
    out = []
    for i, (d, t, *_) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = plain(t), plain(edited), plain(after)
        text = lambda x: "".join(f"{v:02x}" for v in x)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), round(likeness(a, b), 12), round(likeness(a, c), 12)))
    return sorted(out, key=repr)


def got(spark, rows):
    out = fp.compared_with_edits(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 12), round(r[6], 12)) for r in out), key=repr)


def test_defined_cases(spark):
    rows = [(1, None, "x"), (5, "", "x"), (3, "a b c", "x"), (2, "é ü 😀 d e f g", "x"), (7, "a b c d e f", "x"), (7, "a b c d e f", "x"), (9, "w" * 50_000, "x"), (None, "null id here", "x"), (-4, "one", "x")]
    assert got(spark, rows) == expected(rows)
    assert got(spark, rows[:1]) == expected(rows[:1])
    assert got(spark, []) == []


def test_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"], "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(spark, rows) == expected(rows)


def test_many_ranges(spark):
    rows = [(i * 7919 % 100_003, f"text number {i} of many more words {i % 13}", "") for i in range(1500)]
    assert got(spark, rows) == expected(rows)


def test_one_id_for_most_rows(spark):
    alike = [(7, "the same words in every one of these rows", "")] * 900
    shared = [(None, f"text {i} without an id of its own", "") for i in range(700)]
    rows = [(i, f"text number {i} of many more words {i % 13}", "") for i in range(-150, 150)] + alike + shared
    assert got(spark, rows) == expected(rows)
    assert got(spark, alike) == expected(alike)
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = fp.with_next(docs, {"bins": F.col("text")})
    assert plan.columns == ["doc_id", "text", "bins", "next_bins"]
    cuts = fp._cuts(docs, F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("hash")))
    assert 20 < len(cuts) < 40 and len(set(cuts)) < len(cuts) - 8


def test_large_ids(spark):
    rows = [(2**62 + i * 3, f"text number {i} of many more words {i % 13}", "") for i in range(1000)]
    assert got(spark, rows) == expected(rows)


def test_likeness_estimates_jaccard(spark):
    base = [f"w{i}" for i in range(2000)]
    edited = list(base)
    for i in range(0, 2000, 50):
        edited[i] = "changed"
    a = {tuple(base[i : i + 5]) for i in range(1996)}
    b = {tuple(edited[i : i + 5]) for i in range(1996)}
    row = spark.createDataFrame([(" ".join(base), " ".join(edited))], "a string, b string").select(fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b")))).first()[0]
    assert abs(row - len(a & b) / len(a | b)) < 0.15


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = fp.compared_with_edits(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

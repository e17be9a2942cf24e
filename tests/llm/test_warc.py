import base64
import hashlib

from pyspark.sql import functions as F

from weavegrid.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def expected(rows, min_bytes=0):
    pages = [(i, (h or "").encode()) for i, _, h, *_ in rows]
    top = {}
    for i, p in pages:
        if i is not None and len(p) >= min_bytes:
            top[p] = max(top.get(p, i), i)
    out = []
    for i, p in pages:
        revisit = i is not None and p in top and top[p] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", top[p] if revisit else None))
    return sorted(out, key=repr)


def got(spark, rows, **kw):
    found = warc.archived(spark.createDataFrame(rows, SCHEMA), **kw)
    rows = found.collect()
    assert all(r["payload_digest"] == r["declared_digest"] for r in rows)
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=repr)


ROWS = [(1, "http://a", "same", "x"), (2, None, "same", "x"), (9, "http://c\r\nX: y", "same", "x"), (3, "u", None, "x"), (4, "u", "", "x"), (5, "u", "é" * 10_000, "x"), (6, "u", FAKE, "x"), (7, "u", "start " + FAKE * 3 + "WARC/1.1\r\n", "x"), (8, "u", "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n", "x"), (None, "u", "no id", "x")]


def test_defined_cases(spark):
    assert got(spark, ROWS) == expected(ROWS)
    assert got(spark, ROWS, min_bytes=5) == expected(ROWS, 5)
    assert got(spark, []) == []


def test_many_repeats_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [(i, "u", f"page {i % 3}" if i % 2 else "hot", "x") for i in range(60)]
    assert got(spark, rows) == expected(rows)


def test_small_splits(spark):
    """Chains over many splits, with payloads full of magic lines."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = [(i, f"http://x/{i}", ("text " * (i % 40) + FAKE * (i % 3) + f"end {i % 50}"), "") for i in range(300)]
        assert got(spark, rows) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_broken_record_ends_its_file(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([(i, "u", f"page {i}", "") for i in range(4)], SCHEMA).coalesce(1), path)
    (part,) = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part")]
    data = part.read_bytes()
    at = data.index(b"Content-Length", data.index(b"urn:page:2"))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "f.warc").write_bytes(data[:at] + b"Content-Length: x" + data[data.index(b"\r\n", at) :])
    found = warc.read_archives(spark, str(tmp_path / "broken"))
    assert sorted(r["page_id"] for r in found.collect()) == [0, 1]


def test_records_follow_the_format(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([(1, "http://a", "x", ""), (2, "http://a", "x", "")], SCHEMA).coalesce(1), path)
    (part,) = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part")]
    text = part.read_bytes().decode()
    assert text.count("WARC/1.1\r\n") == 2 and text.endswith("\r\n\r\n")
    assert "WARC-Refers-To: <urn:page:2>" in text and "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" in text


def test_base32(spark):
    rows = spark.createDataFrame([("a",), ("",)], "t string").select("t", warc.base32_sha1(F.col("t").cast("binary")).alias("d")).collect()
    for r in rows:
        assert r["d"] == base64.b32encode(hashlib.sha1(r["t"].encode()).digest()).decode()

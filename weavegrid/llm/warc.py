"""WARC archives: writing with revisit records, reading by boundary chains.

Writing: one record a page, as text rows ended by the record separator, so
Spark's own writer and commit protocol make the files, in any store it knows.
Of pages with equal payloads (of ``min_bytes`` or more) the one with the
largest page_id becomes a response, the others revisits that refer to it and
carry no payload. Rows that repeat the largest page_id are all responses.

Reading: files are split at every occurrence of the magic line, wherever Spark
cuts its splits. Each occurrence is a candidate; its header gives the offset of
its successor. Candidates are true only if a chain of successors leads to them
from the start of the file; those inside payloads are not reached:

1. per split, offsets are running sums of chunk lengths, and every candidate
   gets its exit, the first successor outside the split (a walk within it);
2. exits between splits are followed by pointer jumping from the start of all
   files at once, in a number of rounds logarithmic in the splits of a file;
3. per split, the chain is walked again from the entry that was reached.

Records whose payload holds the magic are put together from their chunks.
Memory is bounded by a record and the offsets of a split.

Defined cases: null html is an empty payload; a null page_id or url is kept as
null; a record without a usable length ends its file's chain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weavegrid.llm.common import discard, new_path, ship, stored

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
LENGTH = "([0-9]{1,15})"
#: Rows of (digest, page_id), or of (file, split, first), that may be broadcast: 10 to 40 MB.
BROADCAST_ROWS = 200_000
# RFC 4648's alphabet for groups of five bits in order.
HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1; 160 bits are 32 groups of five, so nothing is padded."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), HEX32, BASE32)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write a record per row of ``pages`` (page_id, url, html) under ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    repeated = stored(
        rows.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n"),
        "repeated",
    )
    n = repeated.count()
    if n:
        rows = rows.join(F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated, "digest", "left")
        rows = rows.withColumn("refers_to", F.when((F.col("page_id") != F.col("refers_to")) & (F.octet_length("html") >= min_bytes), F.col("refers_to")))
    else:
        rows = rows.withColumn("refers_to", F.lit(None).cast("long"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn("refers_to")), line("X-Payload-Length", F.octet_length("html").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)
    discard(repeated)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What follows each magic line (or the start of a file), with its split and its order there."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(F.col("value").cast("binary").alias("chunk"), "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"))
    )


def _field(name: str, value: str = "([^\r\n]*)") -> Column:
    found = F.regexp_extract(F.concat(F.lit("\r\n"), F.col("head")), f"(?i)\r\n{name}: *{value}", 1)
    return F.when(found != "", found)


def _with_length(rows: DataFrame) -> DataFrame:
    """``rows`` with the place where the block starts and its stated length; no record here is 2 GiB long, so a longer one is none."""
    length = _field("Content-Length", LENGTH).cast("long")
    return rows.withColumn("start", F.octet_length("head") + len(END)).withColumn("length", F.when(length < 2**31 - 2**20, length).cast("int"))


def _payload(chunk: Column, start: Column, length: Column) -> Column:
    """The block without its HTTP header."""
    block = F.substring(chunk, start + 1, length)
    header = F.octet_length(F.substring_index(block.cast("string"), END, 1)) + len(END)
    return F.substring(block, header + 1, F.greatest(length - header, F.lit(0)))


def _grouped(batches):
    """Rows sorted by file and split, in batches, to one table for each split."""
    kept, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, split = batch.column("file").to_numpy(zero_copy_only=False), batch.column("split").to_numpy()
        cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (split[1:] != split[:-1])) + 1).tolist(), len(split)]
        for a, b in zip(cuts, cuts[1:]):
            if kept and at != (file[a], split[a]):
                yield pa.Table.from_batches(kept)
                kept = []
            at = file[a], split[a]
            kept.append(batch.slice(a, b - a))
    if kept:
        yield pa.Table.from_batches(kept)


def _exits(batches):
    """Offsets, successors and exits of a split's candidates."""
    for t in _grouped(batches):
        size, record = t.column("size").to_numpy(), t.column("record").to_numpy(zero_copy_only=False)
        ends = np.cumsum(size + len(MAGIC)) + t.column("base")[0].as_py()
        at = ends - size - 2 * len(MAGIC)  # of the magic before each chunk; below 0 for what precedes a file's first
        after = np.where(np.isnan(record.astype(float)), -1, at + np.nan_to_num(record.astype(float))).astype(np.int64)
        leave = after.copy()
        pos = np.searchsorted(at, after)
        inside = (pos < len(at)) & (at[np.minimum(pos, len(at) - 1)] == after)
        for i in range(len(at) - 1, -1, -1):  # successors lie behind, so theirs are known
            if inside[i] and after[i] > at[i]:
                leave[i] = leave[pos[i]]
        own = [t.column(c).combine_chunks() for c in ("file", "split", "seq")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(at), pa.array(after), pa.array(leave)], names=["file", "split", "seq", "at", "after", "leave"])


def _reached(batches):
    """The candidates on the chain from a split's entry."""
    for t in _grouped(batches):
        entries = {e for e in t.column("entry").to_pylist() if e is not None}
        at, after = t.column("at").to_numpy(), t.column("after").to_numpy()
        true = np.zeros(len(at), bool)
        for e in entries:
            i = int(np.searchsorted(at, e))
            while i < len(at) and at[i] == e and not true[i] and after[i] > e:
                true[i] = True
                e = after[i]
                i = int(np.searchsorted(at, e))
        chosen = t.select(["file", "split", "seq", "at", "after"]).filter(pa.array(true)).combine_chunks()
        yield from chosen.to_batches()


def _entries(exits: DataFrame) -> DataFrame:
    """(file, entry): offsets at which chains from the starts of files enter splits.

    Pointer jumping: after round i all entries within 2^i splits of the start
    are known, and every jump leads 2^i splits on.
    """
    targets = exits.select("file", F.col("leave").alias("at")).distinct()
    jumps = stored(exits.select("file", "at", "leave").join(targets, ["file", "at"], "left_semi").union(exits.where("at = 0").select("file", "at", "leave")).distinct(), "jumps")
    reached = stored(exits.where("at = 0").select("file", F.col("at").alias("entry")), "reached")
    known = reached.count()
    while True:
        on = reached.join(jumps, (reached["file"] == jumps["file"]) & (reached["entry"] == jumps["at"])).select(reached["file"], jumps["leave"].alias("entry"))
        on = on.join(jumps.select("file", F.col("at").alias("entry")), ["file", "entry"], "left_semi")
        after = stored(reached.union(on).distinct(), "reached")
        n = after.count()
        discard(reached)
        reached = after
        if n == known:
            discard(jumps)
            return reached
        known = n
        far = jumps.select("file", F.col("at").alias("leave"), F.col("leave").alias("far"))
        # a jump that leads to no candidate ends there
        doubled = stored(jumps.join(far, ["file", "leave"], "left").select("file", "at", F.coalesce("far", "leave").alias("leave")), "jumps")
        discard(jumps)
        jumps = doubled


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, declared_digest of the records under ``path``."""
    ship(spark)
    raw = _with_length(_chunks(spark, path).withColumn("head", F.substring_index("value", END, 1)))
    size = F.octet_length("value").cast("long")
    record = (F.col("start") + F.col("length") + len(END)).cast("long")
    closed = F.col("length").isNotNull() & (size == record)  # else the payload holds the magic, or this isn't a record
    payload = _payload(F.col("chunk"), F.col("start"), F.col("length"))
    parsed = raw.select(
        "file",
        "split",
        "seq",
        size.alias("size"),
        (len(MAGIC) + record).alias("record"),
        closed.alias("closed"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").cast("long").alias("page_id"),
        _field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        _field("WARC-Target-URI").alias("url"),
        _field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("declared_digest"),
        _field("X-Payload-Length", LENGTH).cast("long").alias("declared_bytes"),
        F.when(closed, F.octet_length(payload)).cast("long").alias("payload_bytes"),
        F.when(closed, base32_sha1(payload)).alias("payload_digest"),
    )
    found = stored(parsed, "candidates")
    splits = found.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"), F.min("seq").alias("first"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = stored(splits.select("file", "split", "first", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base")), "splits")
    exits = stored(
        found.select("file", "split", "seq", "size", "record")
        .join(splits.drop("first"), ["file", "split"])
        .repartition("file", "split")
        .sortWithinPartitions("file", "split", "seq")
        .mapInArrow(_exits, "file string, split long, seq long, at long, after long, leave long"),
        "exits",
    )
    entries = _entries(exits)
    # an entry belongs to the split that holds a candidate there
    placed = exits.join(entries.withColumn("at", F.col("entry")), ["file", "at"], "left")
    true = (
        placed.select("file", "split", "seq", "at", "after", "entry")
        .repartition("file", "split")
        .sortWithinPartitions("file", "split", "seq")
        .mapInArrow(_reached, "file string, split long, seq long, at long, after long")
    )
    records = stored(found.join(true, ["file", "split", "seq"]), "records")
    whole = records.where("closed")
    parted = records.where("not closed")
    if parted.limit(1).count():
        whole = whole.unionByName(_put_together(spark, path, parted, exits, splits))
    revisit = F.col("record_type") == "revisit"
    return whole.select(
        "page_id",
        "url",
        "record_type",
        F.when(revisit, F.col("refers_to")).alias("refers_to"),
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "declared_digest",
    )


def _put_together(spark: SparkSession, path: str, parted: DataFrame, exits: DataFrame, splits: DataFrame) -> DataFrame:
    """Records that hold the magic, with digests over all their chunks.

    The files are read once more for them. Chunks are known by their place in
    their split, which doesn't depend on how splits are dealt to tasks.
    """
    ranges = parted.select("file", F.col("at").alias("record_at"), F.col("after").alias("record_end"))
    # each chunk of such a record, by a join on the megabyte that it starts in
    megabyte = 20
    spread = ranges.withColumn("part", F.explode(F.sequence(F.shiftright("record_at", megabyte), F.shiftright("record_end", megabyte))))
    chunk = exits.select("file", "split", "seq", "at").withColumn("part", F.shiftright("at", megabyte))
    inside = chunk.join(spread, ["file", "part"]).where("at >= record_at and at < record_end")
    order = F.col("seq") - F.col("first")
    wanted = inside.join(splits, ["file", "split"]).select("file", "split", order.alias("place"), "at", "record_at")
    again = _chunks(spark, path)
    firsts = again.groupBy("file", "split").agg(F.min("seq").alias("first"))
    firsts = F.broadcast(firsts) if splits.count() <= BROADCAST_ROWS else firsts  # a row a split
    chunks = again.join(firsts, ["file", "split"]).select("file", "split", (F.col("seq") - F.col("first")).alias("place"), "chunk")
    whole = (
        wanted.join(chunks, ["file", "split", "place"])
        .groupBy("file", "record_at")
        .agg(F.sort_array(F.collect_list(F.struct("at", "chunk"))).alias("chunks"))
        .select("file", F.col("record_at").alias("at"), F.expr(f"aggregate(slice(chunks, 2, size(chunks)), chunks[0].chunk, (a, c) -> concat(a, cast('{MAGIC[:-2]}\\r\\n' as binary), c.chunk))").alias("chunk"))
    )
    whole = _with_length(whole.withColumn("head", F.substring_index(F.col("chunk").cast("string"), END, 1)))
    payload = _payload(F.col("chunk"), F.col("start"), F.col("length"))
    whole = whole.select("file", "at", F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("payload_digest"))
    return parted.drop("payload_bytes", "payload_digest").join(whole, ["file", "at"])


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    path = new_path(pages.sparkSession, "archives")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)

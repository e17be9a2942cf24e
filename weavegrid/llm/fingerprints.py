"""Document fingerprints: one-permutation MinHash, in DataFrame functions only.

The hashes of a text's five-word shingles are binned once by their top bits;
each of 128 bins keeps its least. A bin that stays empty borrows from the
non-empty bin that comes first in a random order of its own (optimal
densification, Shrivastava 2017: all texts use the same orders). Of each bin
the lowest 8 bits are stored, as two hexadecimal digits. Equal bins by chance
(1 in 256) are corrected for in ``likeness``.

Words are runs without white space. A text of one to four words has one
shingle, all of them, and a text without words (null too) has the hash of the
empty string as its only one; so texts without words are alike.

Very long texts are taken whole. Rows that share a doc_id follow each other by a
hash of their texts; rows that repeat have equal results, but for the last of
them, which another document follows. Only doc_id and text are read, so other
columns may have any name. No step compares or groups documents, and rows alike
are dealt over several ranges, so nothing here is skewed by copies.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
BINS = 128
BITS = 8
_SHIFT = 64 - 7  # 2 ** 7 bins


def let(value: Column, then) -> Column:
    """``then(value)``, with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    """The 64-bit hashes of a text's shingles, at least one."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")

    def shingles(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - WORDS), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(WORDS)]))
        return F.when(F.size(h) >= WORDS, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array(F.xxhash64(F.lit(""))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def fingerprint(text: Column) -> Column:
    """The low bits of each bin, as an array of BINS small integers."""
    bin_of = lambda x: F.shiftrightunsigned(x, _SHIFT)
    low = lambda x: x.bitwiseAND(F.lit((1 << BITS) - 1))
    least = let(
        F.sort_array(shingle_hashes(text)),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))),
    )

    def filled(m: Column) -> Column:
        # the place of a bin in the order of bin j: a hash of both; its low bits make room for the value
        place = lambda j, x: F.xxhash64(j, bin_of(x)).bitwiseAND(F.lit(-(1 << BITS)))
        borrowed = lambda j: low(F.array_min(F.transform(m, lambda x: place(j, x).bitwiseOR(low(x)))))
        table = F.map_from_arrays(F.transform(m, bin_of), F.transform(m, low))
        return let(table, lambda t: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), lambda j: F.coalesce(F.element_at(t, j), borrowed(j)).cast("smallint")))

    return let(least, filled)


def packed(bins: Column) -> Column:
    return F.array_join(F.transform(bins, lambda b: F.lpad(F.lower(F.hex(b)), BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, corrected for bins equal by chance."""
    same = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: p["a"] == p["b"])) / BINS
    chance = 2.0**-BITS
    return F.greatest((same - chance) / (1 - chance), F.lit(0.0))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""
    return docs.select("doc_id", packed(fingerprint(F.col("text"))).alias("fingerprint"))


#: Rows that one range of ids holds at least, how many ranges there are at most, and sampled rows for each cut between them.
RANGE_ROWS, RANGES, SAMPLED = 64, 32768, 4


def _cuts(docs: DataFrame, at: Column) -> list[tuple[int, int]]:
    """Where ranges of ``docs`` by ``at`` begin, in order, from the least on; one that rows repeat often comes often. At most RANGES, of a sample of SAMPLED times as many."""
    n = docs.count()
    ways = max(1, min(RANGES, n // RANGE_ROWS))
    places = docs.select(at.alias("at"), (F.rand(42) < ways * SAMPLED / max(n, 1)).alias("sampled"))
    least, sample = places.agg(F.min("at"), F.collect_list(F.when(F.col("sampled"), F.col("at")))).first()
    return [tuple(x) for x in ([least] if n else []) + sorted(sample)[SAMPLED::SAMPLED]]


def with_next(docs: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """``docs`` with next_*: the carried columns of the next row by doc_id, then by a hash of the text; after the last row comes the first.

    Rows are cut into ranges at sampled places in that order. A range's first
    rows are also sent to the range before it (those of the first to the last),
    so one shuffle and a window over each range do. Rows that are alike in
    doc_id and text and fill several ranges are dealt over these at random: the
    next of such a row is like itself, but for the last one in the last of the
    ranges. (That none falls there has a chance of e^-64 for each such group of
    rows.) A null doc_id comes first.
    """
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    cuts = _cuts(docs, key)
    if not cuts:
        rows = docs.withColumns(carried)
        return rows.withColumns({f"next_{c}": F.col(c) for c in carried})
    first = [0] * len(cuts)
    for i in range(1, len(cuts)):
        first[i] = first[i - 1] if cuts[i] == cuts[i - 1] else i
    # both folded to one literal
    bounds = F.from_json(F.lit(json.dumps([{"id": i, "hash": h} for i, h in cuts])), "array<struct<id:bigint,hash:bigint>>")
    firsts = F.from_json(F.lit(str(first)), "array<int>")
    steps = F.array(*[F.lit(1 << i) for i in range(RANGES.bit_length(), -1, -1)])
    last = F.aggregate(steps, F.lit(0), lambda a, s: a + F.when((a + s < len(cuts)) & (F.get(bounds, a + s) <= F.col("key")), s).otherwise(F.lit(0)))
    starts = F.get(bounds, F.col("last")) == F.col("key")
    spread = F.col("last") - F.floor(F.rand(43) * (F.col("last") - F.col("first") + 1)).cast("int")
    target = lambda r, wraps, real: F.struct(r.cast("int").alias("range"), F.lit(wraps).alias("wraps"), F.lit(real).alias("real"))
    leads = F.col("starts") & (F.col("at") == F.col("first"))
    targets = F.filter(
        F.array(
            target(F.col("at"), 0, True),
            F.when(leads & (F.col("at") > 0), target(F.col("at") - 1, 0, False)),
            F.when(leads & (F.col("at") == 0), target(F.lit(len(cuts) - 1), 1, False)),
        ),
        lambda t: t.isNotNull(),
    )
    rows = docs.withColumns(carried).withColumn("key", key).withColumn("last", last)
    rows = rows.withColumns({"first": F.get(firsts, F.col("last")), "starts": starts}).withColumn("at", F.when(F.col("starts"), spread).otherwise(F.col("last")))
    own = [*docs.columns, *[c for c in carried if c not in docs.columns]]
    rows = rows.withColumn("inner", F.col("starts") & (F.col("at") < F.col("last"))).withColumn("target", F.explode(targets)).select(*own, "key", "inner", "target.*")
    order = Window.partitionBy("range").orderBy("wraps", "key", "text")
    rows = rows.withColumns({f"next_{c}": F.when(F.col("inner"), F.col(c)).otherwise(F.lead(c).over(order)) for c in carried})
    return rows.where("real").select(*own, *[f"next_{c}" for c in carried])


def compared_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is replaced by what the next document begins with."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, {"text": F.col("text"), "bins": fingerprint(F.col("text"))})
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (n - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("n_chars", n).withColumn("edited", edited).select("doc_id", "n_chars", "edited", "bins", "next_bins").withColumn("edited_bins", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("bins")).alias("fingerprint"),
        packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )

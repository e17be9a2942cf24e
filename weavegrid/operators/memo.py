"""Contexts that a model made once, remembered in a table by a hash of what they were made of.

The memo holds hash, context, last_used (the number of the run that last asked
for it), and is replaced as a versioned table, so a run that fails leaves the
memo as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weavegrid.functions.hooks import answered, echo
from weavegrid.operators.scratch import dropped, kept
from weavegrid.sources import versions

TABLE = "contexts"
CAPACITY = 5000
_SCHEMA = "hash string, context string, last_used long"


def remembered(rows: DataFrame, path: str, content: str = "content", model: Callable[[list[str]], list[str]] = echo, capacity: int = CAPACITY) -> tuple[DataFrame, dict[str, int]]:
    """``rows`` with context and error, and how many contents were found, made, failed and evicted.

    Equal contents are one; only those that the memo lacks go to the model
    (an anti-join by hash). New contexts are appended; a content for which the
    model failed isn't remembered. Of more than ``capacity`` those stay that
    runs asked for last, by hash among equals. A null content is asked for as
    an empty one.
    """
    spark = rows.sparkSession
    now = versions.manifest(spark, path)
    run = now["number"] + 1 if now else 1
    memo = versions.read(spark, path, TABLE) if now else spark.createDataFrame([], _SCHEMA)
    text = F.coalesce(F.col(content).cast("string"), F.lit(""))
    asked = kept(rows.select(F.sha2(text, 256).alias("hash"), text.alias("prompt")).groupBy("hash").agg(F.first("prompt").alias("prompt")))
    made = kept(answered(asked.join(memo, "hash", "left_anti"), model).select("hash", F.col("answer").alias("context"), "error"))
    found = memo.join(asked, "hash", "left_semi").select("hash", "context")
    good = made.where("error is null").select("hash", "context")
    fresh = found.unionByName(good).withColumn("last_used", F.lit(run).cast("long"))
    every = kept(fresh.unionByName(memo.join(asked, "hash", "left_anti").select("hash", "context", "last_used")))
    stays = _latest(every, capacity)
    content_of = versions.load(spark, path, {TABLE: stays})
    counts = {"found": found.count(), "made": good.count(), "failed": made.where("error is not null").count()}
    counts["evicted"] = every.count() - content_of["rows"][TABLE]
    contexts = kept(fresh.select("hash", "context", F.lit(None).cast("string").alias("error")).unionByName(made.where("error is not null").select("hash", "context", "error")))
    dropped(asked, made, every)
    return rows.withColumn("_hash", F.sha2(text, 256)).join(contexts.withColumnRenamed("hash", "_hash"), "_hash", "left").drop("_hash"), counts


def _latest(rows: DataFrame, capacity: int) -> DataFrame:
    """The ``capacity`` rows used last: whole runs, and of the run that goes beyond it those with the smallest hashes."""
    runs = rows.groupBy("last_used").agg(F.count("*").alias("n"))  # a row a run
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("last_used")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = kept(runs.withColumn("room", F.lit(capacity) - before))
    whole = rows.join(runs.where("room >= n").select("last_used"), "last_used", "left_semi")
    cut = runs.where("room > 0 and room < n").first()
    out = whole.select("hash", "context", "last_used")
    if cut:
        part = rows.where(F.col("last_used") == cut["last_used"]).orderBy("hash").limit(int(cut["room"]))
        out = out.unionByName(part.select("hash", "context", "last_used"))
    return out

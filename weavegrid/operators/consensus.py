"""Consensus by frequency-weighted votes of similar records.

votes: record_id, similarity, ids (array), frequency, total, pos (input order: a number, or a position of ``sources.tables``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vote_counts(votes: DataFrame) -> DataFrame:
    """record_id, similarity (null: over all), entry_id, votes, first_pos: both levels in one pass."""
    rows = votes.select("record_id", "similarity", "frequency", "pos", F.explode("ids").alias("entry_id"))
    grouped = rows.groupingSets([["record_id", "similarity", "entry_id"], ["record_id", "entry_id"]], "record_id", "similarity", "entry_id")
    return grouped.agg(F.sum("frequency").alias("votes"), F.min("pos").alias("first_pos"))


def consensus(votes: DataFrame) -> DataFrame:
    """record_id, consensus (most votes; of ties the first seen), votes."""
    counts = vote_counts(votes).where("similarity is null")
    return counts.groupBy("record_id").agg(F.min_by("entry_id", F.struct(-F.col("votes"), F.col("first_pos"))).alias("consensus"), F.max("votes").alias("votes"))


def top_per_similarity(votes: DataFrame, k: int = 3) -> DataFrame:
    """record_id, similarity, rank, entry_id, votes."""
    counts = vote_counts(votes).where("similarity is not null")
    w = Window.partitionBy("record_id", "similarity").orderBy(F.desc("votes"), "first_pos")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("record_id", "similarity", "rank", "entry_id", "votes")


def tiers(votes: DataFrame) -> DataFrame:
    """record_id, high (95 or more), medium (85 to 94), low: distinct ids, in order of similarity, then of input."""
    rows = votes.select("record_id", "similarity", "pos", F.explode("ids").alias("entry_id"))
    rows = rows.groupBy("record_id", "entry_id", F.when(F.col("similarity") >= 95, "high").when(F.col("similarity") >= 85, "medium").otherwise("low").alias("tier")).agg(F.min(F.struct(-F.col("similarity"), F.col("pos"))).alias("at"))
    rows = rows.groupBy("record_id", "tier").agg(F.sort_array(F.collect_list(F.struct("at", "entry_id"))).alias("l"))
    of = lambda t: F.coalesce(F.first(F.when(F.col("tier") == t, F.transform("l", lambda x: x["entry_id"])), ignorenulls=True), F.array().cast("array<string>")).alias(t)
    return rows.groupBy("record_id").agg(of("high"), of("medium"), of("low"))


def totals(votes: DataFrame) -> DataFrame:
    """record_id, total: the sum over similarities of the first row's total."""
    first = votes.groupBy("record_id", "similarity").agg(F.min_by("total", "pos").alias("total"))
    return first.groupBy("record_id").agg(F.sum("total").alias("total"))


def empty_insight(records: DataFrame, insight: DataFrame) -> DataFrame:
    """Every record with its insight, or a typed empty one."""
    return records.join(insight, "record_id", "left").withColumn("votes", F.coalesce("votes", F.lit(0).cast("long")))

"""Token usage roll-ups and cost estimates.

log: record_id, stage, pos (order), input_length, input_words, output_length, output_words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weavegrid.functions.config import COST, Cost

MEASURES = ("input_length", "input_words", "output_length", "output_words")


def by_stage(log: DataFrame) -> DataFrame:
    return log.groupBy("stage").agg(
        F.count("*").alias("n"),
        *[F.sum(m).alias(f"sum_{m}") for m in MEASURES],
        *[F.avg(m).alias(f"avg_{m}") for m in MEASURES],
        *[f(m).alias(f"{n}_{m}") for m in ("input_length", "output_length") for n, f in (("min", F.min), ("max", F.max))],
    )


def by_record(log: DataFrame) -> DataFrame:
    """Sums over the last row of each stage."""
    last = log.groupBy("record_id", "stage").agg(F.max_by(F.struct(*MEASURES), "pos").alias("m"))
    return last.groupBy("record_id").agg(F.count("*").alias("stages"), *[F.sum(f"m.{m}").alias(f"sum_{m}") for m in MEASURES])


def all_levels(log: DataFrame) -> DataFrame:
    """Sums by stage, by record and over all, in one pass; the other level's key is null."""
    sets = log.groupingSets([["stage"], ["record_id"], []], "stage", "record_id")
    return sets.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), *[F.sum(m).alias(f"sum_{m}") for m in MEASURES])


def tokens(words: Column, c: Cost = COST) -> Column:
    return (words / c.words_per_token).cast("long")


def cost(input_words: Column, output_words: Column, c: Cost = COST) -> Column:
    return input_words / c.words_per_token / 1000 * c.input_per_1k + output_words / c.words_per_token / 1000 * c.output_per_1k


def priced(rows: DataFrame, c: Cost = COST) -> DataFrame:
    """Rows of word sums with tokens and cost."""
    i, o = F.col("sum_input_words"), F.col("sum_output_words")
    return rows.withColumns({"input_tokens": tokens(i, c), "output_tokens": tokens(o, c), "cost": cost(i, o, c)})


def cost_summary(priced_rows: DataFrame) -> DataFrame:
    """One row: how many records, and the average, least, largest and total cost."""
    return priced_rows.agg(F.count("*").alias("n"), F.avg("cost").alias("average"), F.min("cost").alias("least"), F.max("cost").alias("largest"), F.sum("cost").alias("total"))

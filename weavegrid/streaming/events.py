"""Structured Streaming forms: windowed counts, bounded and remembered contexts, isolated records."""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def windowed(events: DataFrame, window: Column, watermark: str | None = None) -> DataFrame:
    """start, end, event_type, n, total of each window; the same on batches and on streams."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    grouped = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def tumbling(events: DataFrame, size: str = "1 hour", watermark: str | None = None) -> DataFrame:
    return windowed(events, F.window("ts", size), watermark)


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    return windowed(events, F.window("ts", size, slide), watermark)


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """user_id, start, end, n of each run of events without a gap of ``gap`` or more."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    grouped = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def last_n(rows: DataFrame, key: str, order: list[str], n: int = 5) -> DataFrame:
    """The last n rows of each key: the bounded context, on a batch."""
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def last_n_stream(rows: DataFrame, key: str, value: str, n: int = 5) -> DataFrame:
    """key, context (the last n values), after every batch, on a stream: a state of n values a key.

    Values of a batch count in their sorted order, after those of earlier batches.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(k, frames, state: GroupState):
        import pandas as pd

        new: list = []  # the n largest so far, however many a batch has
        for f in frames:
            new = heapq.nlargest(n, [*new, *f[value].tolist()])
        held = ([*(state.get[0] if state.exists else [])] + new[::-1])[-n:]
        state.update((held,))
        yield pd.DataFrame({key: [k[0]], "context": [held]})

    kind = rows.schema[value].dataType.simpleString()
    of_key = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {of_key}, context array<{kind}>", f"held array<{kind}>", "update", GroupStateTimeout.NoTimeout)


def remembered_stream(asked: DataFrame, key: str, make: Callable, ttl_seconds: int = 3600) -> DataFrame:
    """key, context: ``make(key)`` for every key asked for in a batch, kept as state and made anew once it hasn't been asked for in ``ttl_seconds``.

    A state is one text a key, held where the key's rows are; those of keys that
    nobody asks for any more are removed by the first batch after their time.
    As Spark runs batches without data for such removals, a query that should
    end (``availableNow``) needs spark.sql.streaming.noDataMicroBatches.enabled
    off when it starts.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    ttl = 1000 * ttl_seconds

    def update(k, frames, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        for _ in frames:  # only that the key was asked for counts
            pass
        now = state.getCurrentProcessingTimeMs()
        context, last = state.get if state.exists else (None, 0)
        if context is None or now - last > ttl:
            context = make(k[0])
        state.update((context, now))
        state.setTimeoutDuration(ttl)
        yield pd.DataFrame({key: [k[0]], "context": [context]})

    of_key = asked.schema[key].dataType.simpleString()
    return asked.groupBy(key).applyInPandasWithState(update, f"{key} {of_key}, context string", "context string, last long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def process_records(spark: SparkSession, source: str, schema: str, process: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_at_once: int = 16):
    """Start a stream that processes record files in small batches; records that fail go to ``sink``/rejected with their error, and the stream goes on.

    A batch that fails is halved by a hash of its rows until what fails is one
    record, or rows that are equal. Each part has a folder of its own below
    batch_id, which is written anew when a batch is run again.
    """

    def attempt(rows: DataFrame, batch_id: int, part: str) -> None:
        try:
            process(rows.drop("_hash")).write.mode("overwrite").parquet(f"{sink}/processed/batch_id={batch_id}/part=p{part}")
        except Exception as e:  # noqa: BLE001
            if len(part) >= 63 or rows.select("_hash").distinct().limit(2).count() < 2:
                rows.drop("_hash").withColumn("error", F.lit(str(e)[:500])).write.mode("overwrite").parquet(f"{sink}/rejected/batch_id={batch_id}/part=p{part}")
                return
            bit = F.shiftrightunsigned("_hash", len(part)).bitwiseAND(1)
            for side in (0, 1):
                half = rows.where(bit == side)
                if half.limit(1).count():
                    attempt(half, batch_id, f"{part}{side}")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("_hash", F.xxhash64(*batch.columns)).persist()
        try:
            attempt(batch, batch_id, "")
        finally:
            batch.unpersist()

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

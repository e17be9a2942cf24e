"""The usage log as a stream: records come as files, count once, and are appended once.

A record is delivered again when a writer or a batch is tried again. Those of
the same record, stage, time and measures are one, as long as they come within
the watermark; a batch that Spark runs again writes its own folder anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weavegrid.operators.usage import MEASURES, by_stage
from weavegrid.sources.tables import USAGE_SCHEMA

KEY = ("record_id", "stage", "timestamp")


def usage_stream(spark: SparkSession, folder: str, watermark: str = "1 hour", files_at_once: int = 16) -> DataFrame:
    """record_id, stage, timestamp and measures of CSV files as they come, without what is delivered twice within the watermark."""
    schema = USAGE_SCHEMA.replace("timestamp string", "timestamp timestamp")
    rows = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_at_once).csv(folder)
    rows = rows.withColumnRenamed("cve_id", "record_id").withWatermark("timestamp", watermark)
    return rows.dropDuplicatesWithinWatermark([*KEY, *MEASURES])


def append(rows: DataFrame, path: str, checkpoint: str):
    """Start appending a stream to ``path``; a batch that is run again replaces what it wrote before."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended(spark: SparkSession, path: str) -> DataFrame:
    """What has been appended so far."""
    return spark.read.parquet(path).drop("batch_id")


def stage_totals(rows: DataFrame) -> DataFrame:
    """Roll-up by stage, held as state on a stream (one state a stage); the same as ``usage.by_stage`` on a batch."""
    return by_stage(rows)


def keep_totals(rows: DataFrame, path: str, checkpoint: str):
    """Start to keep the roll-up of a stream as a versioned table: readers see that of a whole batch."""
    from weavegrid.sources import versions

    def write(batch: DataFrame, batch_id: int) -> None:
        versions.load(batch.sparkSession, path, {"by_stage": batch.withColumn("batch_id", F.lit(batch_id))})

    return stage_totals(rows).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

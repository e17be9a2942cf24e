"""Tables of intermediate results in the session's shared folder, and the package in the workers."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where a local master has none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='weavegrid-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, for functions that run in their Python workers."""
    context = spark.sparkContext
    if not getattr(context, "_weavegrid_sent", False):
        package = Path(__file__).parents[1]
        folder = os.path.realpath(tempfile.mkdtemp(prefix="weavegrid-"))  # the driver's own: Spark serves the file from there
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/weavegrid.zip", "w") as out:
            for f in sorted(package.rglob("*.py")):
                out.write(f, f.relative_to(package.parent))
        context.addPyFile(f"{folder}/weavegrid.zip")
        context._weavegrid_sent = True


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back, which cuts its lineage; the table goes with ``dropped``, or when the application ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/weavegrid-core-{spark.sparkContext.applicationId}"
    p, files = _files(spark, folder)
    if not files.exists(p):
        files.mkdirs(p)
        files.deleteOnExit(p)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``kept`` that nothing will read again."""
    for df in tables:
        p, files = _files(df.sparkSession, df.kept_at)
        files.delete(p, True)


@contextlib.contextmanager
def few_rows_a_batch(spark: SparkSession, n: int):
    """Jobs that run within it send at most ``n`` rows a batch to Python workers: for large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)

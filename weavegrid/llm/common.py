"""Shared helpers: tables cut from their lineage, text chunks, components."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, so that
    their Python workers can import it wherever the driver found it."""
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


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where the session names none (tests on a local master) a temporary folder
    is used; on a cluster that is an error, as executors share no local disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='weavegrid-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the application's own in the shared folder; what is left there goes when the driver's JVM ends."""
    context = spark.sparkContext
    folder = f"{shared_folder(spark)}/weavegrid-{context.applicationId}"
    if getattr(context, "_weavegrid_folder", None) != folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        context._weavegrid_folder = folder
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, tidy: bool = False, rows_a_file: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later jobs read the files, so a lost executor costs no recomputation of
    what led to them. ``df.stored_path`` is set for ``discard``. With ``tidy``
    the shuffle files of the job go once it has ended. ``rows_a_file`` (0: no
    bound) is for tables of large rows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    try:
        spark.conf.set(name, str(tidy or before == "true").lower())
        df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    finally:
        spark.conf.set(name, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``stored`` that nothing will read again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


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


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Runs of white space (Unicode's White_Space) on which the tokenizers' patterns may exhaust their stack.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def without_long_blanks(text: str, marks: tuple[str, ...] = ()):
    """(part, is_piece) of a text for a byte-level BPE: pieces are what its pattern takes of very long runs of white space.

    That is all of a run but its last character, which goes with what follows,
    or the whole run before the end of the text or one of the special tokens ``marks``.
    """
    at = 0
    for m in _BLANKS.finditer(text):
        end = m.end() if m.end() == len(text) or text.startswith(marks, m.end()) else m.end() - 1
        yield text[at : m.start()], False
        yield text[m.start() : end], True
        at = end
    yield text[at:], False


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores as make it none of ``columns``, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches, column: str | int = "text", size: int = 1 << 20):
    """Record batches cut into parts of about ``size`` bytes of text, so that a
    worker holds few texts as Python objects at once; one long text is a part."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        start = 0
        while start < len(ends):
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): every
    round is a few joins and minimum aggregates over the links, which never
    outnumber those given, and O(log^2) rounds suffice. Each round is written
    as a table, so lineage stays short. They end when each node has one link,
    to a node that has none: then the links are stars around the smallest.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stored(links, "links")
    while not _are_stars(now):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = stored(small, "links")
        discard(now)
        discard(large)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _are_stars(links: DataFrame) -> bool:
    """Whether each u has one link and no v is a u; both in one pass over the nodes."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).union(links.select("v", F.lit(0), F.lit(1)))
    counts = ends.groupBy("node").agg(F.sum("as_u").alias("as_u"), F.max("as_v").alias("as_v"))
    return not counts.where("as_u > 1 or as_u = 1 and as_v = 1").limit(1).count()


def one_row(kind: pa.DataType, values, mask: np.ndarray | None = None) -> pa.Array:
    """``values`` as the array that one row holds; null where ``mask`` is true."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind, mask=mask)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

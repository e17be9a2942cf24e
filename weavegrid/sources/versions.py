"""Tables that are replaced as a whole: versions beside each other, and a manifest that names the one to read.

A load writes a new folder first and switches the manifest last, by a rename,
so readers see the version before or the version after and never a part. The
version before stays, for readers that have begun; older ones, and what failed
loads have left, go with the next load.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "_current.json"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict | None:
    """version (its folder), number, rows of each table; None where nothing has been loaded."""
    p, files = _files(spark, f"{path}/{MANIFEST}")
    if not files.exists(p):
        return None
    stream = files.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _switch(spark: SparkSession, path: str, content: dict) -> None:
    """Replace the manifest in one step."""
    jvm = spark._jvm
    new, files = _files(spark, f"{path}/.{uuid.uuid4().hex}")
    out = files.create(new)
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else files.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(files.makeQualified(new), files.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")), options)


def load(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> dict:
    """Write ``tables`` (by name) as the next version and switch to it; all of them change at once. Returns the manifest."""
    now = manifest(spark, path)
    number = now["number"] + 1 if now else 1
    version = f"v{number}-{uuid.uuid4().hex[:8]}"
    rows = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
        rows[name] = spark.read.parquet(f"{path}/{version}/{name}").count()
    content = {"number": number, "version": version, "rows": rows, "before": now["version"] if now else None}
    _switch(spark, path, content)
    p, files = _files(spark, path)
    for status in files.listStatus(p):
        if status.isDirectory() and status.getPath().getName() not in (content["version"], content["before"]):
            files.delete(status.getPath(), True)
    return content


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the version that the manifest names now."""
    now = manifest(spark, path)
    if now is None:
        raise FileNotFoundError(f"nothing has been loaded into {path}")
    return spark.read.parquet(f"{path}/{now['version']}/{name}")


def needs_load(spark: SparkSession, path: str, name: str, expected: int, slack: int = 10, excess: float = 1.1) -> bool:
    """Whether a table is missing, has grown beyond ``excess`` or differs by ``slack`` rows or more; by the manifest, without a job."""
    now = manifest(spark, path)
    if now is None or name not in now["rows"]:
        return True
    n = now["rows"][name]
    return n > excess * expected or abs(n - expected) >= slack


def loaded_once(spark: SparkSession, path: str, build, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """The tables of ``names``, built by ``build()`` (tables by name) where they haven't been loaded yet."""
    now = manifest(spark, path)
    if now is None or set(names) - set(now["rows"]):
        load(spark, path, build())
    return {n: read(spark, path, n) for n in names}

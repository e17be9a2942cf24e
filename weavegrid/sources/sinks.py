"""Writers: JSON, Markdown, CSV, graph and vector tables, run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weavegrid.functions.text import shortened
from weavegrid.operators.graph import valid_edges

# Sources of answers, and their columns in the benchmark table, in its order
BENCHMARK_SOURCES = {
    "agents_resolution": "Agent_Resolution",
    "agents_criticism": "Agent_Criticism",
    "agents_analysis": "Agent_Analysis",
    "primary_cwes": "Primary_CWEs",
    "secondary_cwes": "Secondary_CWEs",
    "consensus_cwe": "Consensus_CWE",
    "top_similar_cwes": "Top_Similar_CWEs",
    "retriever_dense": "Retriever_Dense",
    "retriever_sparse": "Retriever_Sparse",
    "retriever_graph": "Retriever_Graph",
}


def write_json(rows: DataFrame, path: str, by: str | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_csv(rows: DataFrame, path: str, append: bool = False) -> None:
    """Nested columns go in as JSON text."""
    flat = rows.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in rows.dtypes])
    flat.write.mode("append" if append else "overwrite").csv(path, header=True)


def write_markdown(rows: DataFrame, path: str, title: str = "title", body: str = "body") -> None:
    """One document a row: a heading and a body, with an empty line after."""
    rows.select(F.concat(F.lit("# "), title, F.lit("\n\n"), body, F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def run_summary(results: DataFrame, errors: DataFrame) -> DataFrame:
    """CVE_ID, Detected_CWEs (joined by a pipe), Processing_Time; failed records say ERROR."""
    good = results.select(F.col("record_id").alias("CVE_ID"), F.array_join("ids", "|").alias("Detected_CWEs"), F.format_number("seconds", 2).alias("Processing_Time"))
    return good.union(errors.select("record_id", F.lit("ERROR"), F.lit("0.00")))


def search_log(hits: DataFrame, k: int = 5) -> DataFrame:
    """The first k hits of each query that is a record id."""
    return hits.where(F.col("query_id").startswith("CVE-") & (F.col("rank") <= k)).select("query_id", "rank", "entry_id", "score")


def preview(rows: DataFrame, text: str = "description", most: int = 200) -> DataFrame:
    return rows.withColumn(text, shortened(F.col(text), most, most))


def benchmark_csv(results: DataFrame, truth: DataFrame) -> DataFrame:
    """By CVE: the true ids, those of each source and those that any source matched; sets are sorted and joined by semicolons.

    results: record_id, source, entry_id (null or empty for a record without
    ids); truth: record_id, entry_id. Records without results go; sources
    without a column count only for matches.
    """
    rows = results.select("record_id", "source", "entry_id").union(truth.select("record_id", F.lit(None).cast("string"), "entry_id"))
    ids = lambda own: F.collect_set(F.when(own, F.nullif("entry_id", F.lit(""))))
    given = F.col("source").isNotNull()
    sets = {"Benchmark_CWEs": ids(~given)} | {c: ids(F.col("source") == s) for s, c in BENCHMARK_SOURCES.items()}
    grouped = rows.groupBy(F.col("record_id").alias("CVE")).agg(*[v.alias(c) for c, v in sets.items()], ids(given).alias("given"), F.count_if(given).alias("n"))
    matched = F.array_intersect("Benchmark_CWEs", "given").alias("Matched_CWEs")
    found = grouped.where("n > 0").select("CVE", *sets, matched)
    return found.select("CVE", *[F.array_join(F.sort_array(c), ";").alias(c) for c in found.columns[1:]]).orderBy("CVE")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables anew; edges with a missing end are left out."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    valid_edges(nodes, edges).write.mode("overwrite").parquet(f"{path}/edges")


def write_vectors(rows: DataFrame, path: str) -> None:
    """id, payload columns and embedding; rows without an entry are left out."""
    rows.where(F.col("id").isNotNull()).withColumn("embedding", F.col("embedding").cast("array<float>")).write.mode("overwrite").parquet(path)


def needs_reload(spark: SparkSession, path: str, expected: int, slack: int = 10, excess: float = 1.1) -> bool:
    """Whether a stored table is missing, has grown beyond ``excess`` or differs by ``slack`` rows or more."""
    try:
        n = spark.read.parquet(path).count()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return True
        raise
    return n > excess * expected or abs(n - expected) >= slack


def reset(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

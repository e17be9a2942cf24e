"""Ids in results of any shape: JSON of records read as VARIANT and taken apart by its own structure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weavegrid.operators.scratch import dropped, kept

PREFIX = "CWE-"
#: Arrays of ids by the names that results have for them.
LISTED = ("primary_cwes", "secondary_cwes")
RETRIEVERS = ("dense", "sparse", "graph")
ROLES = ("resolution", "analysis", "criticism")


def _exploded(rows: DataFrame, of: str) -> DataFrame:
    """pos, key, value of the elements of a variant's array or object, beside the other columns."""
    return rows.alias("r").lateralJoin(rows.sparkSession.tvf.variant_explode(F.col(f"r.{of}").outer())).drop(of)


def _kind(v) -> F.Column:
    """array, object, string or the like."""
    return F.lower(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))


def _text(v, path: str = "$"):
    """The text at a path; null where there is none, or no text."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(_kind(at) == "string", F.try_variant_get(v, path, "string"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """record_id and result (a VARIANT) of JSON files whose root is an object keyed by record, or a list of objects that name theirs in cve_id.

    A text that can't be read (an object that repeats a key can't), or a root
    of another kind, gives no rows.
    """
    return results_of(spark.read.text(path, wholetext=True))


def results_of(texts: DataFrame) -> DataFrame:
    """``read_results`` of texts (value)."""
    roots = texts.select(F.try_parse_json("value").alias("root")).where("root is not null").withColumn("kind", _kind(F.col("root"))).where("kind in ('object', 'array')")
    rows = _exploded(roots, "root").where(_kind(F.col("value")) == "object")
    return rows.select(F.coalesce("key", _text(F.col("value"), "$.cve_id")).alias("record_id"), F.col("value").alias("result")).where("record_id is not null")


def ids_at_any_depth(rows: DataFrame, of: str) -> DataFrame:
    """record_id, entry_id: ids in the lists of a variant column, nested to any depth: texts, and objects that hold one in cwe_id.

    Lists are opened level by level; what is left of a level is stored, so the
    number of jobs is the depth and no row holds a whole list.
    """
    found = []
    open_lists = rows.select("record_id", F.col(of).alias("list")).where(_kind(F.col("list")) == "array")
    spent = []
    while True:
        items = kept(_exploded(open_lists, "list").select("record_id", "value").withColumn("kind", _kind(F.col("value"))))
        spent.append(items)
        text = F.when(F.col("kind") == "string", _text(F.col("value"))).when(F.col("kind") == "object", _text(F.col("value"), "$.cwe_id"))
        found.append(items.select("record_id", text.alias("entry_id")).where(F.col("entry_id").startswith(PREFIX)))
        open_lists = items.where("kind = 'array'").select("record_id", F.col("value").alias("list"))
        if not open_lists.limit(1).count():
            break
    out = kept(reduce(DataFrame.union, found).distinct())
    dropped(*spent)
    return out


def ids_by_source(results: DataFrame) -> DataFrame:
    """record_id, source, entry_id of every source of ids in results (record_id, result), distinct.

    A retriever's set holds the ids with a normalised score of its own that
    isn't null; an agent's role holds those for which it gives a name.
    """
    results = kept(results)  # made once for all sources
    at = lambda path: F.try_variant_get("result", path, "variant")
    rows = lambda source, ids: ids.select("record_id", F.lit(source).alias("source"), "entry_id")
    items = lambda path: _exploded(results.select("record_id", at(path).alias("list")).where(_kind(F.col("list")) == "array"), "list")
    named = lambda ids, names: ids.select("record_id", F.explode(F.array_compact(F.array(*names))).alias("source"), "entry_id")
    out = [rows(c, items(f"$.{c}").select("record_id", _text(F.col("value")).alias("entry_id"))) for c in LISTED]
    out.append(rows("consensus_cwe", results.select("record_id", _text(F.col("result"), "$.consensus_cwe").alias("entry_id"))))
    out.append(rows("top_similar_cwes", ids_at_any_depth(results.select("record_id", at("$.top_similar_cwes").alias("list")), "list")))
    hits = items("$.retrievers").select("record_id", _text(F.col("value"), "$.cwe_id").alias("entry_id"), "value")
    score = lambda r: F.try_variant_get("value", f"$.normalized_scores.{r}", "variant")
    out.append(named(hits, [F.lit("retrievers"), *[F.when(score(r).isNotNull() & ~F.is_variant_null(score(r)), F.lit(f"retriever_{r}")) for r in RETRIEVERS]]))
    agents = _exploded(results.select("record_id", at("$.agents").alias("object")).where(_kind(F.col("object")) == "object"), "object").select("record_id", F.col("key").alias("entry_id"), "value")
    out.append(named(agents, [F.when(F.length(F.coalesce(_text(F.col("value"), f"$.{role}.name"), F.lit(""))) > 0, F.lit(f"agents_{role}")) for role in ROLES]))
    found = kept(reduce(DataFrame.union, out).where("entry_id <> ''").distinct())
    dropped(results)
    return found

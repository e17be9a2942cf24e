"""Fusion of several retrievers' hits into one auditable score.

Hits are long: query_id, entry_id, retriever, score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weavegrid.functions.config import SCORING, Scoring
from weavegrid.functions.scoring import abstraction_factor, normalized, relationship_bonus, retriever_weight, shared_factor, usage_factor
from weavegrid.operators.sparse import ranked

RETRIEVERS = ("dense", "sparse", "graph")


def best_hits(hits: DataFrame) -> DataFrame:
    """The best score of each query, entry and retriever."""
    return hits.groupBy("query_id", "entry_id", "retriever").agg(F.max("score").alias("score"))


def dedupe_keep_max(hits: DataFrame) -> DataFrame:
    """One row a query and entry: its best score, of ties the first retriever by name."""
    return hits.groupBy("query_id", "entry_id").agg(F.max("score").alias("score"), F.min_by("retriever", F.struct(-F.col("score"), "retriever")).alias("retriever"))


def provenance(hits: DataFrame, s: Scoring = SCORING) -> DataFrame:
    """query_id, entry_id, raw, normalised and weighted score by retriever, in one aggregate (no pivot's second pass)."""
    rows = best_hits(hits)
    norm = normalized(F.col("retriever"), F.col("score"), s)
    rows = rows.withColumn("norm", norm).withColumn("part", norm * retriever_weight(F.col("retriever"), s))
    of = lambda r, c: F.max(F.when(F.col("retriever") == r, F.col(c)))
    return rows.groupBy("query_id", "entry_id").agg(
        *[of(r, "score").alias(f"{r}_raw") for r in RETRIEVERS],
        *[of(r, "norm").alias(f"{r}_norm") for r in RETRIEVERS],
        *[of(r, "part").alias(f"{r}_part") for r in RETRIEVERS],
        F.sort_array(F.collect_set("retriever")).alias("retrievers"),
    )


def weighted_sum(*columns: str) -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))


def contributions(rows: DataFrame) -> DataFrame:
    """``provenance`` with the weighted sum and each retriever's share of it in percent."""
    total = weighted_sum(*[f"{r}_part" for r in RETRIEVERS])
    rows = rows.withColumn("weighted", total)
    by = F.when(F.col("weighted") > 0, F.col("weighted")).otherwise(F.lit(1.0))
    return rows.withColumns({f"{r}_pct": F.coalesce(F.col(f"{r}_part"), F.lit(0.0)) / by * 100 for r in RETRIEVERS})


def fuse(hits: DataFrame, entries: DataFrame, k: int | None = None, mode: str = "union", scoring: str = "plain") -> DataFrame:
    """query_id, entry_id, every step of the score, score and rank.

    entries: entry_id, abstraction, usage, n_relations. mode: union keeps all
    entries, sparse_gated only those that the sparse retriever found as well.
    scoring: plain, or shared for the documented variant.
    """
    rows = contributions(provenance(hits))
    if mode == "sparse_gated":
        rows = rows.where(F.array_contains("retrievers", "sparse"))
    elif mode != "union":
        raise ValueError(f"mode must be union or sparse_gated: {mode}")
    rows = rows.join(entries, "entry_id", "left")
    graph_only = (F.size("retrievers") == 1) & F.array_contains("retrievers", "graph")
    rows = rows.withColumns(
        {
            "abstraction_factor": abstraction_factor(F.coalesce("abstraction", F.lit("Unknown"))),
            "relationship_bonus": relationship_bonus(graph_only, F.coalesce("n_relations", F.lit(0))),
            "usage_factor": usage_factor(F.coalesce("usage", F.lit("Not specified"))),
        }
    )
    score = F.col("weighted") * F.col("abstraction_factor") * F.col("relationship_bonus") * F.col("usage_factor")
    if scoring == "shared":
        n = F.size("retrievers")
        score = score * shared_factor(n, weighted_sum(*[f"{r}_norm" for r in RETRIEVERS]) / n)
    return ranked(rows.withColumn("score", score), k, entry="entry_id")


def score_ranges(hits: DataFrame) -> DataFrame:
    """Hits with the least and largest score of their query and retriever."""
    w = Window.partitionBy("query_id", "retriever")
    return hits.withColumns({"least": F.min("score").over(w), "largest": F.max("score").over(w)})


def score_statistics(hits: DataFrame, by: str = "retriever") -> DataFrame:
    return hits.groupBy(by).agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("largest"), F.avg("score").alias("mean"), F.median("score").alias("median"))


def overlap(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How many entries each combination of retrievers found, by query or over all."""
    found = hits.groupBy("query_id", "entry_id").agg(F.array_join(F.sort_array(F.collect_set("retriever")), "+").alias("found_by"))
    return found.groupBy(*(by or []), "found_by").agg(F.count("*").alias("n_entries"))


def effectiveness(hits: DataFrame) -> DataFrame:
    """retriever, hits, mean normalised score, entries that no other retriever found."""
    rows = best_hits(hits).withColumn("norm", normalized(F.col("retriever"), F.col("score")))
    alone = F.count("*").over(Window.partitionBy("query_id", "entry_id")) == 1
    return rows.withColumn("alone", alone).groupBy("retriever").agg(F.count("*").alias("hits"), F.avg("norm").alias("mean_norm"), F.count_if("alone").alias("unique_finds"))


def rerank(hits: DataFrame, k: int, model=None) -> DataFrame:
    """The first k by a model's score (a column function of the hit), or by the score they have."""
    return ranked(hits if model is None else hits.withColumn("score", model(F.struct(*hits.columns))), k, entry="entry_id")


def with_mapping(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """Hits with abstraction, usage, rationale, comments, reasons and suggestions, as far as ``entries`` has them, and defaults where an entry is unknown.

    Reasons and suggestions are lists, whether entries hold one or many; those
    of unknown entries are empty.
    """
    kinds = dict(entries.dtypes)
    lists = [F.when(F.col(c).isNotNull(), F.array(c)).alias(c) if not kinds[c].startswith("array") else F.col(c) for c in ("reasons", "suggestions") if c in kinds]
    own = entries.select(*[c for c in entries.columns if c not in ("reasons", "suggestions")], *lists)
    rows = hits.join(own, "entry_id", "left")
    defaults = {"abstraction": "Unknown", "usage": "Not specified", "rationale": "", "comments": ""}
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(d)) for c, d in defaults.items() if c in kinds})
    return rows.withColumns({c: F.coalesce(F.col(c), F.slice(F.array(F.lit(None).cast(rows.schema[c].dataType.elementType)), 1, 0)) for c in ("reasons", "suggestions") if c in kinds})


def abstraction_fixed(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, entry_id, abstraction: that of the entry; of an unknown entry that several retrievers found, the type that the dense or else the graph retriever gives; else Unknown.

    hits: query_id, entry_id, retriever, type; entries: entry_id, abstraction.
    """
    of = lambda r: F.min(F.when(F.col("retriever") == r, F.col("type")))
    found = hits.groupBy("query_id", "entry_id").agg(F.countDistinct("retriever").alias("n"), of("dense").alias("dense"), of("graph").alias("graph"))
    known = found.join(entries.select("entry_id", F.col("abstraction").alias("known")), "entry_id", "left")
    given = F.when(F.col("n") > 1, F.coalesce("dense", "graph"))
    return known.select("query_id", "entry_id", F.coalesce("known", given, F.lit("Unknown")).alias("abstraction"))


def raw_results(hits: DataFrame, entries: DataFrame, preview: int = 200) -> DataFrame:
    """query_id, retriever, json: what each retriever found by itself for a query, before fusion: how many, the results by score, and the statistics of their scores.

    entries: entry_id, name, abstraction, usage, description; ids lose their
    prefix, descriptions are cut to ``preview`` letters and dots, and what isn't
    known has a default.
    """
    rows = best_hits(hits).join(entries, "entry_id", "left")
    of = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    text = F.when(of("description", "") != "", F.concat(F.substring("description", 1, preview), F.lit("..."))).otherwise("")
    shown = F.struct(
        F.regexp_replace(F.col("entry_id").cast("string"), "^CWE-", "").alias("cwe_id"), of("name", "Unknown").alias("name"), of("abstraction", "unknown").alias("abstraction"),
        F.format_number("score", 4).alias("score"), text.alias("description"), of("usage", "Not specified").alias("mapping_usage"),
    )
    number = lambda x: F.format_number(x, 6)
    grouped = rows.groupBy("query_id", "retriever").agg(
        F.count("*").alias("count"),
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("by"), "entry_id", shown.alias("result")))).alias("l"),
        F.struct(number(F.min("score")).alias("min"), number(F.max("score")).alias("max"), number(F.avg("score")).alias("mean")).alias("statistics"),
    )
    return grouped.select("query_id", "retriever", F.to_json(F.struct("count", F.transform("l", lambda x: x["result"]).alias("results"), "statistics")).alias("json"))


def result_rows(fused: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of a results table as text: rank, id, name, abstraction, usage, score to four places, retrievers, and each one's score to three.

    entries: entry_id, name, abstraction, usage; what isn't known has a default.
    """
    each = lambda f: F.array_join(F.filter(F.array(*[F.when(F.col(f"{r}_norm").isNotNull(), f(r)) for r in RETRIEVERS]), lambda x: x.isNotNull()), ", ")
    known = entries.select("entry_id", *[F.col(c).alias(f"known_{c}") for c in ("name", "abstraction", "usage")])
    rows = fused.join(known, "entry_id", "left")
    shown = {"name": "Unknown", "abstraction": "Unknown", "usage": "Not specified"}
    return rows.select(
        "query_id", "rank", "entry_id", *[F.coalesce(f"known_{c}", F.lit(d)).alias(c) for c, d in shown.items()],
        F.format_number("score", 4).alias("score"), each(F.lit).alias("retrievers"), each(lambda r: F.concat(F.lit(f"{r}="), F.format_number(f"{r}_norm", 3))).alias("found_by"),
    )


def formatted_sparse(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, rank, json: sparse hits with their id (without its prefix), name, abstraction and usage as text."""
    rows = hits.join(entries, "entry_id", "left")
    number = F.regexp_replace(F.col("entry_id").cast("string"), "^CWE-", "").alias("id")
    of = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c)
    return rows.select("query_id", "rank", F.to_json(F.struct(number, of("name", "Unknown"), of("abstraction", "Unknown"), of("usage", "Not specified"), F.format_number("score", 4).alias("score"))).alias("json"))


def consolidated(fused: DataFrame, k: int = 10) -> DataFrame:
    """query_id, results: the first k as an array of structs."""
    rows = fused.where(F.col("rank") <= k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "entry_id", "score"))).alias("results"))
    return rows.withColumn("results_count", F.size("results"))

"""Extraction of answers from text, and comparison with a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weavegrid.functions.text import confidence, ids_in

CLASSES = ("primary", "secondary", "tertiary", "contributing")
# The columns that a table of answers may have.
LABELS = {"id": "cwe id", "name": "cwe name", "confidence": "confidence", "abstraction": "abstraction", "mapping": "mapping label", "notes": "notes"}

#: Rows that a task sorts at once where ``by_record`` deals them.
ROWS_A_TASK = 500_000


def document_kind(name: Column) -> Column:
    return (
        F.when(name.endswith("_analysis.md"), "analysis")
        .when(name.endswith("_criticism.md"), "criticism")
        .when(name.endswith("_resolution.md"), "resolution")
        .otherwise("other")
    )


def typed_segments(text: Column, kind: Column) -> Column:
    """The parts of a document that its kind asks for: ``# Final Resolution for`` or ``# Criticism for`` blocks, each up to the next heading.

    Without one: the whole text where it holds a table, else its ``# Summary``
    part, else the whole text.
    """
    blocks = lambda head: F.regexp_extract_all(text, F.lit(rf"(?ms)^# {head}.*?(?=^# |\z)"), F.lit(0))
    own = F.when(kind == "resolution", blocks("Final Resolution for ")).when(kind == "criticism", blocks("Criticism for ")).otherwise(segments(text))
    summary = blocks("Summary")
    whole = F.when(text.rlike(r"(?m)^\s*\|"), F.array(text)).when(F.size(summary) > 0, summary).otherwise(F.array(text))
    return F.when(F.size(own) > 0, own).otherwise(whole)


def segments(text: Column) -> Column:
    """The parts of a document from one first-level heading to the next; the whole text where there is none."""
    found = F.regexp_extract_all(text, F.lit(r"(?ms)^# .*?(?=^# |\z)"), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def answer_class(*texts: Column) -> Column:
    """The class that the first non-blank text names, in order of importance; primary by default."""
    low = F.lower(F.coalesce(*[F.when(F.trim(t) != "", t) for t in texts], F.lit("")))
    case = F.when(F.contains(low, F.lit("primary")), "primary")
    for c in CLASSES[1:]:
        case = case.when(F.contains(low, F.lit(c)), c)
    return case.otherwise("primary")


def table_rows(docs: DataFrame) -> DataFrame:
    """doc_id, pos, cells (label to text) of every row of Markdown tables whose header names an id column."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.trim("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.withColumn("cells", cells)
    header = F.exists("cells", lambda c: F.contains(F.lower(c), F.lit(LABELS["id"])))
    rule = F.forall("cells", lambda c: c.rlike("^:?-*:?$"))
    # the last header before a row is its own; a document's table lines stay together, and they are few
    headed = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.when(header, F.col("cells")).alias("header")))).alias("heads"))
    heads = headed.select("doc_id", F.filter("heads", lambda h: h["header"].isNotNull()).alias("heads"))
    joined = rows.where(~header & ~rule).join(heads, "doc_id")
    own = F.element_at(F.filter("heads", lambda h: h["pos"] < F.col("pos")), -1)["header"]
    named = F.transform(own, lambda h: _label(h))
    return joined.withColumn("names", named).where("names is not null").select("doc_id", "pos", "line", F.map_from_entries(F.filter(F.arrays_zip(F.col("names").alias("k"), F.slice("cells", F.lit(1), F.size("names")).alias("v")), lambda p: p["k"].isNotNull())).alias("cells"))


def _label(header: Column) -> Column:
    low = F.lower(header)
    case = F.when(F.contains(low, F.lit(LABELS["id"])), "id")
    for name, mark in list(LABELS.items())[1:]:
        case = case.when(F.contains(low, F.lit(mark)), name)
    return case


def table_answers(docs: DataFrame) -> DataFrame:
    """doc_id, pos, entry_id, class, confidence, name, mapping of answer tables."""
    rows = table_rows(docs)
    cell = lambda k: F.element_at("cells", k)
    return rows.select(
        "doc_id",
        "pos",
        F.explode(ids_in(cell("id"))).alias("entry_id"),
        answer_class(cell("mapping"), cell("notes"), F.col("line")).alias("class"),
        confidence(cell("confidence")).alias("confidence"),
        cell("name").alias("name"),
        cell("mapping").alias("mapping"),
    )


def text_answers(docs: DataFrame) -> DataFrame:
    """doc_id, pos, entry_id, class of texts without tables: the class that the text names holds for all its ids."""
    return docs.select("doc_id", F.posexplode(ids_in(F.col("text"))).alias("pos", "entry_id"), answer_class(F.col("text")).alias("class"))


def merged_answers(answers: DataFrame) -> DataFrame:
    """record_id and an ordered distinct array of ids for each class; answers: record_id, file, pos, class, entry_id."""
    rows = answers.groupBy("record_id", "class", "entry_id").agg(F.min(F.struct("file", "pos")).alias("at"))
    of = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col("class") == c, F.struct("at", "entry_id")))), lambda x: x["entry_id"]).alias(c)
    return rows.groupBy("record_id").agg(*[of(c) for c in CLASSES])


def by_record(rows: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """``rows`` (counted here) dealt by record_id, about ``rows_a_task`` to a task whatever their number; groupings by record_id that follow need no further shuffle."""
    return rows.repartition(max(1, -(-rows.count() // rows_a_task)), "record_id")


def merged_metadata(files: DataFrame) -> DataFrame:
    """record_id, metadata (of each key the first file's value), sources (file names in order); files: record_id, file, name, metadata (map).

    Tasks sort what they get, so many files are best dealt ``by_record`` first.
    """
    pairs = files.select("record_id", "file", F.explode("metadata").alias("key", "value")).where("value is not null")
    first = pairs.groupBy("record_id", "key").agg(F.min_by("value", "file").alias("value"))
    merged = first.groupBy("record_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("metadata"))
    names = files.groupBy("record_id").agg(F.transform(F.sort_array(F.collect_set(F.struct("file", "name"))), lambda x: x["name"]).alias("sources"))
    return names.join(merged, "record_id", "left").select("record_id", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), "sources")


def id_sources(results: DataFrame) -> DataFrame:
    """record_id, sources_of: each id's sources, sorted; results: record_id, source, entry_id."""
    of = results.groupBy("record_id", "entry_id").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    return of.groupBy("record_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("entry_id", "sources")))).alias("sources_of"))


def compared(results: DataFrame, truth: DataFrame) -> DataFrame:
    """record_id, matched, truth_only, results_only, in_truth; results and truth: record_id, ids."""
    none = F.array().cast("array<string>")
    rows = results.withColumnRenamed("ids", "found").join(truth.withColumnRenamed("ids", "true_ids"), "record_id", "left")
    t, r = F.coalesce("true_ids", none), F.coalesce("found", none)
    return rows.select("record_id", F.col("true_ids").isNotNull().alias("in_truth"), F.sort_array(F.array_intersect(r, t)).alias("matched"), F.sort_array(F.array_except(t, r)).alias("truth_only"), F.sort_array(F.array_except(r, t)).alias("results_only"))


def comparison_summary(rows: DataFrame) -> DataFrame:
    """One row: records, records in the truth, matched ids, coverage and match percentages (null where nothing overlaps)."""
    n = F.count("*")
    covered, hit = F.count_if("in_truth"), F.count_if(F.col("in_truth") & (F.size("matched") > 0))
    return rows.agg(n.alias("n_records"), covered.alias("n_in_truth"), hit.alias("n_matching"), F.coalesce(F.sum(F.size("matched")), F.lit(0)).alias("n_matched_ids"), (covered * 100.0 / F.nullif(n, F.lit(0))).alias("coverage_pct"), (hit * 100.0 / F.nullif(covered, F.lit(0))).alias("match_pct"))


def by_source(results: DataFrame, truth: DataFrame) -> DataFrame:
    """source, matches, total, records; results: record_id, source, entry_id; truth: record_id, entry_id."""
    rows = results.distinct().join(truth.distinct().withColumn("hit", F.lit(True)), ["record_id", "entry_id"], "left")
    return rows.groupBy("source").agg(F.count_if("hit").alias("matches"), F.count("*").alias("total"), F.countDistinct("record_id").alias("records"))


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from tp, fp, fn, tn; null where a denominator is zero."""
    ratio = lambda a, b: a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def common_ids(rows: DataFrame, ids: str, k: int = 10) -> DataFrame:
    """The k ids that most records hold."""
    return rows.select(F.explode(ids).alias("entry_id")).groupBy("entry_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entry_id").limit(k)


def three_sources(extracted: DataFrame, similar: DataFrame, consolidated: DataFrame, key: str = "record_id") -> DataFrame:
    """A full outer join of three tables on their key."""
    return extracted.join(similar, key, "full_outer").join(consolidated, key, "full_outer")


def example_budget(examples: DataFrame, budget: int = 10) -> DataFrame:
    """The first ``budget`` examples over all entries, by entry position, kind, then example position.

    The budget is global, so this is a top-k, which keeps ``budget`` rows a task.
    """
    return examples.orderBy("entry_pos", "kind", "example_pos", "entry_id").limit(budget)


def comparison_report(rows: DataFrame) -> DataFrame:
    """record_id, report: a Markdown section for each record."""
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("none")
    return rows.select("record_id", F.concat_ws("\n", F.concat(F.lit("## "), F.col("record_id")), F.concat(F.lit("- matched: **"), listed("matched"), F.lit("**")), F.concat(F.lit("- benchmark only: "), listed("truth_only")), F.concat(F.lit("- results only: "), listed("results_only"))).alias("report"))


def top_as_primary(ranked: DataFrame, k: int = 3) -> DataFrame:
    """Answers made of a ranking's first k entries, all primary; ranked: record_id, rank, entry_id."""
    return ranked.where(F.col("rank") <= k).select("record_id", F.lit(0).alias("file"), F.col("rank").alias("pos"), F.lit("primary").alias("class"), "entry_id")


def prior_ids(analysis: DataFrame, criticism: DataFrame) -> DataFrame:
    """record_id, ids: what either role named, in order of first mention."""
    a, c = analysis.select("record_id", F.col("ids").alias("a")), criticism.select("record_id", F.col("ids").alias("c"))
    none = F.array().cast("array<string>")
    return a.join(c, "record_id", "full_outer").select("record_id", F.array_union(F.coalesce("a", none), F.coalesce("c", none)).alias("ids"))


def detected_ids(hits: DataFrame) -> DataFrame:
    """query_id, ids of hits that have an entry, best first."""
    rows = hits.where(F.col("entry_id").isNotNull()).groupBy("query_id", "entry_id").agg(F.max("score").alias("score"))
    return rows.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "entry_id"))), lambda x: x["entry_id"].cast("string")).alias("ids"))


def summary_rows(merged: DataFrame, similar: DataFrame, fused: DataFrame, agents: DataFrame) -> DataFrame:
    """One nested row a record from three sources: classes, consensus, ranked entries with their class, and what each agent said.

    merged: record_id and a column for each class; similar: record_id,
    consensus; fused: query_id, entry_id, rank, score; agents: record_id,
    agent, entry_id, confidence.
    """
    from weavegrid.operators.reports import class_of

    ranked = fused.withColumnRenamed("query_id", "record_id").join(merged, "record_id", "left")
    ranked = ranked.select("record_id", "rank", F.col("entry_id").cast("string").alias("entry_id"), "score", F.coalesce(class_of(F.col("entry_id").cast("string")), F.lit("unknown")).alias("class"))
    entries = ranked.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("rank", "entry_id", "score", "class"))).alias("entries"))
    said = agents.groupBy("record_id", "agent").agg(F.sort_array(F.collect_list(F.struct("entry_id", "confidence"))).alias("said"))
    said = said.groupBy("record_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("agent", "said")))).alias("agents"))
    return three_sources(merged, similar, entries).join(said, "record_id", "left")

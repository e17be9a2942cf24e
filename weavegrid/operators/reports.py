"""Texts and tables built from results: prompts, summaries, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weavegrid.functions.text import canonical_id, joined_phrase, shortened
from weavegrid.operators.evaluate import CLASSES


def lines(rows: DataFrame, key: str, order: list[str], line: Column, name: str) -> DataFrame:
    """key and one text of its lines in order."""
    l = rows.select(key, F.struct(*order, line.alias("line")).alias("l")).groupBy(key).agg(F.sort_array(F.collect_list("l")).alias("l"))  # noqa: E741
    return l.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias(name))


def result_table(rows: DataFrame) -> DataFrame:
    """query_id, table: a Markdown table of ranked rows (rank, entry_id, name, score)."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "rank", "entry_id", "name", F.format_number("score", 4)), F.lit(" |"))
    body = lines(rows, "query_id", ["rank"], line, "table")
    return body.withColumn("table", F.concat(F.lit("| rank | id | name | score |\n|---|---|---|---|\n"), "table"))


def mapping_table(rows: DataFrame) -> DataFrame:
    """entry_id, usage, rationale cut to 97 characters and dots where longer than 100."""
    return rows.select("entry_id", "usage", shortened(F.col("rationale"), 100, 97).alias("rationale"))


def phrase_list(phrases: Column) -> Column:
    """Phrases by kind as bullets; a stated text where there are none."""
    bullets = F.transform(F.array_sort(F.map_entries(phrases)), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), F.array_join(e["value"], ", ")))
    return F.when(phrases.isNull() | (F.size(phrases) == 0), F.lit("No keyphrases.")).otherwise(F.array_join(bullets, "\n"))


def relationship_text(edges: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """node, relations: up to ``most`` distinct relations of each node, with the other's name."""
    rows = edges.select(F.col("src").alias("node"), "rel_type", F.col("dst").alias("other")).distinct()
    rows = rows.join(nodes.select(F.col("id").alias("other"), "name"), "other", "left")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("rel_type", "other"))).where(F.col("n") <= most)
    return lines(rows, "node", ["n"], F.concat(F.lit("- "), "rel_type", F.lit(": "), "other", F.lit(" ("), F.coalesce("name", F.lit("unknown")), F.lit(")")), "relations")


def relations_of_first(hits: DataFrame, edges: DataFrame, most: int = 7, each: int = 5) -> DataFrame:
    """record_id, relations: of the first ``most`` entries (query_id, rank, entry_id) that have any, up to ``each`` distinct relations, under a heading for each entry."""
    rows = hits.where(F.col("rank") <= most).select(F.col("query_id").alias("record_id"), "rank", "entry_id")
    related = edges.where("rel_type <> '' and dst <> ''").select(F.col("src").alias("entry_id"), "rel_type", "dst").distinct()
    related = related.withColumn("n", F.row_number().over(Window.partitionBy("entry_id").orderBy("rel_type", "dst"))).where(F.col("n") <= each)
    one = related.groupBy("entry_id").agg(F.sort_array(F.collect_list(F.struct("n", F.concat(F.lit("- "), "rel_type", F.lit(" \u2192 "), "dst").alias("line")))).alias("l"))
    text = F.concat(F.lit("#### "), "entry_id", F.lit(" Relationships\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return lines(rows.join(one, "entry_id"), "record_id", ["rank"], text, "relations")


def enhanced_query(records: DataFrame, consensus: DataFrame, table: DataFrame, relations: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """record_id, prompt: description, phrases, consensus, reference text, candidates and relations; blank sections are left out.

    records: record_id, description, phrases; consensus: record_id, consensus;
    table: query_id, table; relations: record_id, relations (as of
    ``relations_of_first``); references: record_id, text.
    """
    part = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"## {title}\n"), c))
    rows = records.join(consensus.select("record_id", "consensus"), "record_id", "left").join(table.withColumnRenamed("query_id", "record_id"), "record_id", "left").join(relations, "record_id", "left")
    known = [] if references is None else [part("References", F.col("_reference"))]
    if references is not None:
        rows = rows.join(references.select("record_id", F.col("text").alias("_reference")), "record_id", "left")
    phrases = F.array_join(F.transform(F.array_sort(F.map_entries("phrases")), lambda e: F.concat(e["key"], F.lit(": "), joined_phrase(e["value"]))), "\n")
    return rows.select("record_id", F.concat_ws("\n\n", part("Description", F.col("description")), part("Keyphrases", phrases), part("Consensus", F.col("consensus")), *known, part("Candidates", F.col("table")), part("Relations", F.col("relations"))).alias("prompt"))


def final_report(records: DataFrame) -> DataFrame:
    """record_id, report from description, phrases, analysis, criticism and resolution."""
    part = lambda title, c: F.concat(F.lit(f"## {title}\n"), F.coalesce(c, F.lit("none")))
    return records.select("record_id", F.concat_ws("\n\n", F.concat(F.lit("# "), "record_id"), part("Description", F.col("description")), part("Keyphrases", phrase_list(F.col("phrases"))), *[part(x.capitalize(), F.col(x)) for x in ("analysis", "criticism", "resolution")]).alias("report"))


def interpretation(fused: DataFrame) -> DataFrame:
    """Per query: entries, found by several retrievers, with a relationship bonus, of base or variant level, and the retriever that adds most."""
    parts = F.array(*[F.struct(F.coalesce(F.col(f"{r}_part"), F.lit(0.0)).alias("part"), F.lit(r).alias("name")) for r in ("dense", "graph", "sparse")])
    rows = fused.withColumn("top", F.array_max(parts)["name"])
    return rows.groupBy("query_id").agg(
        F.count("*").alias("n_entries"),
        F.count_if(F.size("retrievers") > 1).alias("n_several"),
        F.count_if(F.col("relationship_bonus") > 1).alias("n_bonus"),
        F.count_if(F.lower("abstraction").isin("base", "variant")).alias("n_specific"),
        F.mode("top", True).alias("top_retriever"),
    )


def ids_by_source(answers: DataFrame, similar: DataFrame, hits: DataFrame, agents: DataFrame) -> DataFrame:
    """record_id, source, entry_id of every source of ids, distinct.

    answers: record_id and an array for each class; similar: record_id,
    consensus, top (array); hits: query_id, entry_id, retriever; agents:
    record_id, agent, entry_id.
    """
    of_class = [answers.select("record_id", F.lit(c).alias("source"), F.explode(c).alias("entry_id")) for c in CLASSES]
    rows = of_class + [
        similar.where("consensus is not null").select("record_id", F.lit("consensus").alias("source"), F.col("consensus").alias("entry_id")),
        similar.select("record_id", F.lit("top_similar").alias("source"), F.explode("top").alias("entry_id")),
        hits.select(F.col("query_id").alias("record_id"), F.concat(F.lit("retriever_"), "retriever").alias("source"), F.col("entry_id").cast("string").alias("entry_id")),
        agents.select("record_id", F.concat(F.lit("agent_"), "agent").alias("source"), "entry_id"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.distinct()


def class_of(entry_id: Column) -> Column:
    """The first class whose array holds an id, else unknown."""
    case = F.when(F.array_contains(CLASSES[0], entry_id), CLASSES[0])
    for c in CLASSES[1:]:
        case = case.when(F.array_contains(c, entry_id), c)
    return case.otherwise("unknown")


def retriever_comparison(hits: DataFrame) -> DataFrame:
    """query_id, retriever, found, unique: entries of each retriever, and those no other one found."""
    rows = hits.select("query_id", "retriever", "entry_id").distinct()
    alone = F.count("*").over(Window.partitionBy("query_id", "entry_id")) == 1
    return rows.withColumn("alone", alone).groupBy("query_id", "retriever").agg(F.count("*").alias("found"), F.count_if("alone").alias("unique"))


def node_neighbours(edges: DataFrame) -> DataFrame:
    """node, neighbours: outgoing, then incoming relations of each node, sorted."""
    out = edges.select(F.col("src").alias("node"), F.lit(0).alias("way"), "rel_type", F.col("dst").alias("other"))
    rows = out.union(edges.select(F.col("dst"), F.lit(1), "rel_type", F.col("src"))).distinct()
    return lines(rows, "node", ["way", "rel_type", "other"], F.concat(F.when(F.col("way") == 0, "-> ").otherwise("<- "), "rel_type", F.lit(" "), "other"), "neighbours")


def enriched_response(responses: DataFrame, advice: DataFrame, chains: DataFrame) -> DataFrame:
    """record_id, response with the three most relevant specific and alternative entries and two chains.

    advice: record_id, other, role, relevance; chains: record_id, chain, pos.
    """
    first = lambda rows, n, order: rows.withColumn("n", F.row_number().over(Window.partitionBy("record_id").orderBy(*order))).where(F.col("n") <= n)
    best = [F.desc("relevance"), F.asc("other")]
    specific = lines(first(advice.where("role = 'child'"), 3, best), "record_id", ["n"], F.concat(F.lit("- more specific: "), "other"), "specific")
    other = lines(first(advice.where("role = 'peer'"), 3, best), "record_id", ["n"], F.concat(F.lit("- alternative: "), "other"), "alternative")
    chain = lines(first(chains, 2, [F.asc("pos")]), "record_id", ["n"], F.concat(F.lit("- chain: "), "chain"), "chain")
    rows = responses.join(specific, "record_id", "left").join(other, "record_id", "left").join(chain, "record_id", "left")
    return rows.select("record_id", F.concat_ws("\n", "response", "specific", "alternative", "chain").alias("response"))


def reasoning(advice: DataFrame) -> DataFrame:
    """record_id, text that says how many entries of each role there are; advice: record_id, role."""
    counts = advice.groupBy("record_id", "role").agg(F.count("*").alias("n"))
    return lines(counts, "record_id", ["role"], F.concat(F.col("n"), F.when(F.col("n") == 1, F.lit(" entry is a ")).otherwise(" entries are each a "), "role"), "text")


def summary_report(rows: DataFrame, k: int = 10) -> DataFrame:
    """One row: a Markdown summary of records (record_id, primary, consensus): how many, and the most common ids.

    Only counts reach the one row, never the records.
    """
    n = rows.agg(F.count("*").alias("n"), F.count("consensus").alias("n_consensus"))
    common = lambda ids, title: ids.groupBy("entry_id").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "entry_id").limit(k).agg(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), "entry_id"))).alias("l")).select(F.concat_ws("\n", F.lit(f"## {title}"), F.transform("l", lambda x: F.concat(F.lit("- "), x["entry_id"], F.lit(": "), -x["c"]))).alias(title))
    primary = common(rows.select(F.explode("primary").alias("entry_id")), "primary")
    consensus = common(rows.where("consensus is not null").select(F.col("consensus").alias("entry_id")), "consensus")
    head = F.concat(F.lit("# Summary\n"), "n", F.lit(" records, "), "n_consensus", F.lit(" with a consensus"))
    return n.join(F.broadcast(primary)).join(F.broadcast(consensus)).select(F.concat_ws("\n\n", head, "primary", "consensus").alias("report"))


def usage_report(stages: DataFrame) -> DataFrame:
    """A Markdown table row for each stage (stage, n and rounded averages), and a header, in order."""
    cells = F.concat_ws(" | ", "stage", F.col("n").cast("string"), F.format_number("avg_input_words", 2), F.format_number("avg_output_words", 2))
    head = stages.sparkSession.createDataFrame([(0, "", "| stage | n | input words | output words |"), (1, "", "|---|---|---|---|")], "part int, stage string, line string")
    return head.union(stages.select(F.lit(2), "stage", F.concat(F.lit("| "), cells, F.lit(" |")))).orderBy("part", "stage").select("line")


def bundle(records: DataFrame, references: DataFrame, insight: DataFrame) -> DataFrame:
    """Everything known of a record in one row: description, phrases, reference text and consensus; missing parts are null or empty."""
    rows = records.join(references.select("record_id", F.col("text").alias("reference")), "record_id", "left")
    return rows.join(insight.select("record_id", "consensus", "votes"), "record_id", "left")


def as_json(rows: DataFrame, key: str = "record_id") -> DataFrame:
    """key, json: each row as text, nulls left out; ``from_json`` with the row's schema reads it back."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("json"))


def specifications(asked: DataFrame, entries: DataFrame, most: int = 3) -> DataFrame:
    """record_id, specifications: the entries asked for (record_id, entry_id in any form), each with its name, description, and up to ``most`` mitigations and examples.

    entries: entry_id, name, description, mitigations and examples (arrays).
    """
    rows = asked.withColumn("entry_id", canonical_id(F.col("entry_id"))).where("entry_id is not null").distinct().join(entries, "entry_id")
    bullets = lambda title, c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"{title}:\n- "), F.array_join(F.slice(c, 1, most), "\n- ")))
    text = F.concat_ws("\n", F.concat(F.lit("### "), "entry_id", F.lit(": "), F.coalesce("name", F.lit("Unknown"))), F.nullif(F.coalesce("description", F.lit("")), F.lit("")), bullets("Mitigations", F.col("mitigations")), bullets("Examples", F.col("examples")))
    return lines(rows, "record_id", ["entry_id"], text, "specifications")


def combined_analysis(advice: DataFrame, chains: DataFrame, k: int = 3, diagrams: DataFrame | None = None) -> DataFrame:
    """seed, analysis: counts of advice by role, the k most relevant specifics, the chain, and its diagram where one is given.

    advice: as ``graph.ranked_advice``; chains: seed, node, level, position; diagrams: seed, diagram.
    """
    counts = lines(advice.groupBy("seed", "role").agg(F.count("*").alias("n")), "seed", ["role"], F.concat(F.lit("- "), "role", F.lit(": "), F.col("n")), "roles")
    best = advice.where("role = 'child'").withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("relevance"), "other"))).where(F.col("n") <= k)
    specifics = lines(best, "seed", ["n"], F.concat(F.lit("- "), "other", F.lit(" ("), F.format_number("relevance", 2), F.lit(")")), "specifics")
    chain = lines(chains, "seed", ["level", "node"], F.concat(F.lit("- "), F.coalesce("position", F.lit("ROOT")), F.lit(" "), "node"), "chain")
    rows = counts.join(specifics, "seed", "full_outer").join(chain, "seed", "full_outer")
    part = lambda title, c: F.concat(F.lit(f"## {title}\n"), F.col(c))
    shown = [part("Relations", "roles"), part("More specific", "specifics"), part("Chain", "chain")]
    if diagrams is not None:
        rows = rows.join(diagrams, "seed", "left")
        shown.append(F.concat(F.lit("## Diagram\n```mermaid\n"), F.col("diagram"), F.lit("\n```")))
    return rows.select("seed", F.concat_ws("\n\n", *shown).alias("analysis"))


def run_metrics(results: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: records, failed ones, ids found, records without any, and the seconds taken."""
    done = results.agg(F.count("*").alias("n_processed"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).cast("long").alias("n_ids"), F.count_if(F.size("ids") == 0).alias("n_without"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))
    return done.join(F.broadcast(errors.agg(F.count("*").alias("n_failed"))))

"""Retrieval that joins text, vectors and the graph: starting nodes, seeds and the whole search."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weavegrid.functions.config import GRAPH, RETRIEVAL
from weavegrid.functions.scoring import choice, normalized
from weavegrid.functions.text import ids_in
from weavegrid.operators import dense, fusion, graph, sparse
from weavegrid.operators.scratch import dropped, kept


def node_text(nodes: DataFrame) -> DataFrame:
    """doc_id, text: the name of each node, and its description where it has one."""
    parts = ["name"] + (["description"] if "description" in nodes.columns else [])
    return nodes.select(F.col("id").alias("doc_id"), F.concat_ws(" ", *parts).alias("text"))


def node_postings(nodes: DataFrame) -> DataFrame:
    """``sparse.postings`` of the nodes' texts, for several searches over the same nodes."""
    return sparse.postings(node_text(nodes))


def keyword_matches(nodes: DataFrame, queries: DataFrame, floor: float = 0.3, k: int = 20, held: DataFrame | None = None) -> DataFrame:
    """query_id, node, score, rank: BM25 over the nodes' texts, as a share of the query's best, from ``floor`` on.

    Queries whose words no node has look for nodes that hold them as they
    stand, at score 1. held: ``node_postings``, where they are there already.
    """
    scores = sparse.bm25_scores(node_postings(nodes) if held is None else held, queries).where("score > 0")
    best = scores.groupBy("query_id").agg(F.max("score").alias("best"))
    shares = scores.join(best, "query_id").select("query_id", F.col("doc_id").alias("node"), F.least(F.col("score") / F.col("best"), F.lit(1.0)).alias("score"))
    found = kept(sparse.ranked(shares.where(F.col("score") > floor), k, entry="node"))
    rest = queries.where(F.trim(F.coalesce("text", F.lit(""))) != "").join(found.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "text")
    if rest.limit(1).count():
        found = found.unionByName(sparse.ranked(substrings(rest, nodes), k, entry="node").select(found.columns))
    return found


def mentioned(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, node: existing nodes whose ids a query's text holds."""
    rows = queries.select("query_id", F.explode(ids_in(F.col("text"))).alias("node"))
    return rows.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").select("query_id", "node").distinct()


def phrase_queries(queries: DataFrame) -> DataFrame:
    """A query of its own for each phrase: query_id is a struct of query and phrase."""
    rows = queries.select("query_id", F.explode("phrases").alias("kind", "list")).select("query_id", F.explode("list").alias("text"))
    return rows.select(F.struct(F.col("query_id").alias("query"), F.col("text").alias("phrase")).alias("query_id"), "text")


def all_matches(nodes: DataFrame, queries: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Stored ``keyword_matches`` of every query's text (phrase null) and of each of its phrases, in one pass; query_id is a struct of query and phrase."""
    whole = queries.select(F.struct(F.col("query_id").alias("query"), F.lit(None).cast("string").alias("phrase")).alias("query_id"), "text")
    asked = whole.union(phrase_queries(queries)) if "phrases" in queries.columns else whole
    return kept(keyword_matches(nodes, asked, held=held))


def _of_text(matches: DataFrame, floor: float, k: int) -> DataFrame:
    rows = matches.where(F.col("query_id.phrase").isNull() & (F.col("score") > floor) & (F.col("rank") <= k))
    return rows.select(F.col("query_id.query").alias("query_id"), "node", "score")


def _of_phrases(matches: DataFrame, floor: float, k: int) -> DataFrame:
    rows = matches.where(F.col("query_id.phrase").isNotNull() & (F.col("score") > floor) & (F.col("rank") <= k))
    return rows.groupBy(F.col("query_id.query").alias("query_id"), "node").agg(F.max("score").alias("score"))


def starting_nodes(queries: DataFrame, nodes: DataFrame, floor: float = 0.5, k: int = 5, matches: DataFrame | None = None) -> DataFrame:
    """query_id, node: ids in the query, best matches of each phrase, and, for queries with neither, of the whole text.

    A phrase or text whose words no node has goes by the nodes that hold it as
    it stands. matches: ``all_matches``, where they are there already.
    """
    matches = all_matches(nodes, queries) if matches is None else matches
    found = mentioned(queries, nodes).union(_of_phrases(matches, floor, k).select("query_id", "node")).distinct()
    rest = _of_text(matches, floor, 2 * k).select("query_id", "node").join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.union(rest)


def chain_seeds(queries: DataFrame, nodes: DataFrame, floor: float = 0.4, k: int = 5, matches: DataFrame | None = None) -> DataFrame:
    """query_id, node, score of nodes where chains start: the best phrase match, less a fifth."""
    matches = all_matches(nodes, queries) if matches is None else matches
    return _of_phrases(matches, floor, k).withColumn("score", F.col("score") * 0.8)


def seeds_of_hits(hits: DataFrame, k: int = RETRIEVAL.seeds_each) -> DataFrame:
    """query_id, entry_id: the first k dense and the first k sparse entries of each query."""
    best = fusion.best_hits(hits)
    first = lambda r: sparse.ranked(best.where(F.col("retriever") == r), k, entry="entry_id").select("query_id", "entry_id")
    return first("dense").union(first("sparse")).distinct()


def substrings(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, node, score 1 of nodes whose text holds the whole query, by the index of trigrams."""
    return sparse.phrase_matches(node_text(nodes), queries).select("query_id", F.col("doc_id").alias("node"), F.lit(1.0).alias("score"))


def substring_fallback(queries: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """query_id, node, score 1, rank of nodes that hold the whole query, for use without vectors."""
    return sparse.ranked(substrings(queries, nodes), 2 * k, entry="node")


def graph_hits(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = RETRIEVAL.k, queries: DataFrame | None = None, matches: DataFrame | None = None) -> DataFrame:
    """query_id, node, score of all nine strategies over seeds (query_id, node), combined.

    The strategies that walk go together, one frontier a level. queries
    (query_id, text, and phrases where they are known) are needed for keyword
    matches and starting points of chains; matches: their ``all_matches``.
    """
    own = seeds.select(F.col("query_id").alias("seed"), "node")
    typed = own.join(nodes.select(F.col("id").alias("node"), F.lower("type").alias("type")), "node").select("seed", "node", "type")
    one = F.lit(1.0)
    way = lambda relations, where, w=one: graph.steps(edges, relations, where).select("src", "dst", w.alias("w"))
    forward = F.when(F.col("rel_type").isin(*GRAPH.forward), 1.0).otherwise(0.9)
    # kind: moves, depth, seeds
    kinds = {
        "chain": (way(None, "both", choice(F.col("rel_type"), GRAPH.edge_weights)), 3, own),
        "forward": (way(GRAPH.sequence, "out", forward), 3, own),
        "backward": (way(GRAPH.forward, "in"), 3, own),
        "peers": (way(GRAPH.peer, "both"), 2, own),
        "progression": (way(GRAPH.forward, "out"), 3, own),
        "up": (graph.first_parents(edges).withColumn("w", one), 3, typed.where("type in ('variant', 'base')")),
        "down": (way(("CHILDOF",), "in"), 2, typed.where("type in ('class', 'pillar', 'base')")),
    }
    labelled = lambda rows, kind, *columns: rows.select(F.lit(kind).alias("kind"), *columns)
    moves = reduce(DataFrame.union, [labelled(m, kind, "src", "dst", "w") for kind, (m, _, _) in kinds.items()])
    starts = reduce(DataFrame.union, [labelled(s, kind, "seed", "node") for kind, (_, _, s) in kinds.items()])
    found = graph.walks(moves, starts, {kind: depth for kind, (_, depth, _) in kinds.items()})
    named = lambda rows, name, score: rows.select(F.col("seed").alias("query_id"), "node", F.lit(name).alias("strategy"), score.cast("double").alias("score"))
    level, weight = F.col("level"), F.col("weight")
    fading = lambda x: F.pow(F.lit(x), level - 1)
    of = lambda kind: found.where((F.col("kind") == kind) & (level > 0))
    rich = graph.richness(edges).select(F.col("id").alias("node"), "score").where("score > 0")
    down = found.where("kind = 'down'").join(nodes.select(F.col("id").alias("node"), F.lower("type").alias("type")), "node")
    strategies = [
        named(own, "explicit_mention", one),
        named(of("chain"), "relationship_chain", weight * F.greatest(F.lit(0.5), 1 - 0.2 * (level - 1))),
        named(of("forward"), "sequence_path", weight * fading(0.8)),
        named(of("backward"), "sequence_path", fading(0.8)),
        named(of("peers"), "peer_group", 0.9 * fading(0.7)),
        named(of("progression"), "vulnerability_chain", 0.9 - 0.1 * (level - 1)),
        named(of("up"), "abstraction_path", 0.8 * F.pow(F.lit(0.7), level)),
        named(down, "abstraction_path", choice(F.col("type"), {"base": 0.9, "variant": 0.95}, 0.7) * F.pow(F.lit(0.8), level)),
        named(own.join(rich, "node"), "relationship_richness", F.col("score")),
    ]
    if queries is not None:
        matches = all_matches(nodes, queries) if matches is None else matches
        score = F.col("score")
        strategies.append(named(_of_text(matches, 0.3, 20).withColumnRenamed("query_id", "seed"), "keyword_match", score))
        if "phrases" in queries.columns:
            strategies.append(named(chain_seeds(queries, nodes, matches=matches).withColumnRenamed("query_id", "seed"), "chain_starting_point", score))
    return graph.combined(reduce(DataFrame.union, strategies), nodes, k)


class Outcomes:
    """What each retriever of a search gave: stored hits, or a typed empty table and the error."""

    def __init__(self, spark: SparkSession, query_kind: str):
        self.spark, self.schema = spark, f"query_id {query_kind}, entry_id string, retriever string, score double"
        self.hits: dict[str, DataFrame] = {}
        self.failed: list[tuple[str, str, str]] = []

    def run(self, name: str, plan: Callable[[], DataFrame]) -> DataFrame:
        """Plan and run a retriever by itself; what fails, in its plan or its tasks, fails alone."""
        empty = self.spark.createDataFrame([], self.schema)
        try:
            rows = plan()
            rows = rows.select("query_id", F.col(rows.columns[1]).cast("string").alias("entry_id"), F.lit(name).alias("retriever"), F.col("score").cast("double").alias("score"))
            self.hits[name] = kept(rows)
        except Exception as e:  # noqa: BLE001
            self.failed.append((name, type(e).__name__, str(e)[:500]))
            self.hits[name] = empty
        return self.hits[name]

    def all(self) -> DataFrame:
        return reduce(DataFrame.union, self.hits.values())

    def errors(self) -> DataFrame:
        """retriever, kind, message of each that failed."""
        return self.spark.createDataFrame(self.failed, "retriever string, kind string, message string")


def searched(queries: DataFrame, docs: DataFrame, vectors: DataFrame | None, query_vectors: DataFrame | None, nodes: DataFrame, edges: DataFrame, k: int = RETRIEVAL.k) -> Outcomes:
    """All retrievers, the graph last and seeded by the others, each run and stored by itself.

    docs: doc_id (the entry), text; vectors: vec_id (the entry), embedding;
    queries: query_id, text, and phrases where they are known, by which the
    sparse retriever fans out.
    """
    out = Outcomes(queries.sparkSession, dict(queries.dtypes)["query_id"])
    has_phrases = "phrases" in queries.columns
    sparse_hits = (lambda: sparse.boosted_search(docs, queries, 2 * k)) if has_phrases else (lambda: sparse.bm25_topk(docs, queries.select("query_id", "text"), 2 * k))
    out.run("sparse", lambda: sparse_hits().select("query_id", "doc_id", "score"))
    if vectors is not None:
        out.run("dense", lambda: dense.near_zero_dropped(dense.topk(vectors, query_vectors, 2 * k)).select("query_id", "vec_id", "score"))

    def by_graph() -> DataFrame:
        held = node_postings(nodes)
        matches = all_matches(nodes, queries, held)
        dropped(held)
        named = starting_nodes(queries, nodes, matches=matches) if has_phrases else mentioned(queries, nodes)
        seeds = kept(seeds_of_hits(out.all()).withColumnRenamed("entry_id", "node").union(named).distinct())
        return graph_hits(seeds, nodes, kept(edges), 2 * k, queries, matches).select("query_id", "node", "score")

    out.run("graph", by_graph)
    return out


def search(queries: DataFrame, docs: DataFrame, vectors: DataFrame | None, query_vectors: DataFrame | None, nodes: DataFrame, edges: DataFrame, k: int = RETRIEVAL.k) -> DataFrame:
    """Long hits (query_id, entry_id, retriever, score) of all retrievers that didn't fail, as ``searched``."""
    return searched(queries, docs, vectors, query_vectors, nodes, edges, k).all()


def metadata(docs: DataFrame, vectors: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """retriever, n: what each retriever holds."""
    n = lambda rows, name: rows.agg(F.lit(name).alias("retriever"), F.count("*").alias("n"))
    return n(docs, "sparse").union(n(vectors, "dense")).union(n(nodes, "graph_nodes")).union(n(edges, "graph_edges"))


def top_normalized(hits: DataFrame, k: int = 50) -> DataFrame:
    """Each retriever's own first k with normalised scores, for a report of each by itself."""
    rows = hits.withColumn("norm", normalized(F.col("retriever"), F.col("score")))
    keyed = rows.withColumn("of", F.struct("query_id", "retriever"))
    return sparse.ranked(keyed, k, by="of", entry="entry_id").drop("of")

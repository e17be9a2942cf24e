"""Every query of the library by name, and its SQL.

Queries run over the whole driver tables in the roles that ``standins`` gives
them. Scores are rounded to six places before they are ranked or compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weavegrid.functions import text as tx
from weavegrid.functions.config import GRAPH
from weavegrid.functions.scoring import abstraction_factor, cosine, normalized, usage_factor
from weavegrid.operators import consensus, dense, evaluate, fusion, graph, reports, retrieval, sparse, usage
from weavegrid.plans import standins as st
from weavegrid.plans.standins import ALL_EDGES_SQL, ENTRIES_SQL, GRAPH_SQL, HITS_SQL, KIND_SQL, USAGE_LOG_SQL, USAGE_SQL, VOTES_SQL
from weavegrid.sources import sinks
from weavegrid.streaming import events as ev

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def listed(c: str | Column) -> Column:
    return F.array_join(c, ",")


# -- text retrieval

_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


@query(f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({_TOKENS})) AS BIGINT) AS n_distinct FROM documents")
def tokenize_counts(spark, sf_dir):
    return sparse.token_counts(st.table(spark, sf_dir, "documents"))


# materialised, so that the corpus is taken apart once
_BM25 = f"""held AS MATERIALIZED (SELECT doc_id, {_TOKENS} AS words FROM documents),
size AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, avg(len(words)::DOUBLE) AS avgdl FROM held),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(words)) AS term FROM held) GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw_idf FROM df, size),
idf AS (SELECT term, df, raw_idf, CASE WHEN raw_idf < 0 THEN 0.25::DOUBLE * mean_idf ELSE raw_idf END AS idf FROM raw, (SELECT avg(raw_idf) AS mean_idf FROM raw)),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(words) AS dl, unnest(words) AS term FROM held) GROUP BY doc_id, dl, term)"""


def _bm25_sql(asked: str, digits: int = 6) -> str:
    """CTEs up to scores of queries ``asked`` (query_id, text)."""
    return f"""{_BM25}, asked AS ({asked}),
qtf AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOKENS}) AS term FROM asked) GROUP BY query_id, term),
scores AS (
  SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), {digits}) AS score
  FROM qtf JOIN idf USING (term) JOIN tf USING (term), size GROUP BY query_id, doc_id
)"""


@query(
    f"""WITH {_bm25_sql('SELECT item_id AS query_id, text FROM benchmark')},
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 5"""
)
def bm25_topk(spark, sf_dir):
    return sparse.bm25_topk(st.table(spark, sf_dir, "documents"), st.questions(spark, sf_dir), 5).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {_BM25} SELECT term, df, round(raw_idf, 6) AS raw_idf, round(idf, 6) AS idf FROM idf")
def bm25_idf_floor(spark, sf_dir):
    held = sparse.postings(st.table(spark, sf_dir, "documents"))
    return sparse.idf(sparse.document_frequencies(held), sparse.corpus_size(held)).select("term", "df", r6("raw_idf").alias("raw_idf"), r6("idf").alias("idf"))


_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@query(
    f"""WITH {_bm25_sql(f'''SELECT item_id || '|' || source AS query_id, text FROM (
  SELECT item_id, 'base' AS source, text FROM benchmark
  UNION ALL SELECT item_id, 'rootcause', text || ' ' || array_to_string({_WORDS}[1:2], ' ') FROM benchmark
  UNION ALL SELECT item_id, 'weakness', text || ' ' || array_to_string({_WORDS}[3:4], ' ') FROM benchmark)''')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores),
kept AS (SELECT CAST(split_part(query_id, '|', 1) AS BIGINT) AS query_id, split_part(query_id, '|', 2) AS source, doc_id, score FROM ranked WHERE rank <= CASE WHEN query_id LIKE '%|base' THEN 20 ELSE 10 END),
merged AS (
  SELECT query_id, doc_id, string_agg(source, ',' ORDER BY source) AS sources,
    round(max(score) * (1 + CASE WHEN bool_or(source = 'rootcause') THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN bool_or(source = 'weakness') THEN 1.8::DOUBLE ELSE 0 END), 6) AS score, bool_or(source <> 'base') AS boosted
  FROM kept GROUP BY query_id, doc_id
), final AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM merged)
SELECT query_id, doc_id, sources, score, boosted, rank FROM final WHERE rank <= 5"""
)
def bm25_keyphrase_boost(spark, sf_dir):
    words = F.array_remove(F.split("text", r"\s+"), "")
    phrase = lambda a: F.array(F.array_join(F.slice(words, a, 2), " "))
    asked = st.questions(spark, sf_dir).withColumn("phrases", F.create_map(F.lit("rootcause"), phrase(1), F.lit("weakness"), phrase(3)))
    found = sparse.boosted_search(st.table(spark, sf_dir, "documents"), asked, 5)
    return found.select("query_id", "doc_id", listed("sources").alias("sources"), "score", "boosted", "rank")


@query(
    f"""WITH {_bm25_sql('SELECT item_id AS query_id, text FROM benchmark')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores),
pairs AS (SELECT query_id, doc_id, text FROM ranked JOIN documents USING (doc_id) WHERE rank <= 10 UNION ALL SELECT item_id, NULL, text FROM benchmark),
counts AS (SELECT query_id, doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT query_id, doc_id, unnest(list_filter({_TOKENS}, lambda x: length(x) >= 2)) AS term FROM pairs) GROUP BY query_id, doc_id, term),
fit AS (SELECT query_id, count(*)::DOUBLE AS n FROM pairs GROUP BY query_id),
terms AS (SELECT query_id, term, count(*)::DOUBLE AS df FROM counts GROUP BY query_id, term),
weights AS (SELECT query_id, doc_id, term, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM counts JOIN terms USING (query_id, term) JOIN fit USING (query_id)),
norms AS (SELECT query_id, doc_id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY query_id, doc_id),
unit AS (SELECT w.query_id, w.doc_id, term, w / norm AS u FROM weights w JOIN norms m ON w.query_id = m.query_id AND w.doc_id IS NOT DISTINCT FROM m.doc_id)
SELECT a.query_id, a.doc_id, round(sum(a.u * q.u), 6) AS relevance FROM unit a JOIN unit q ON a.query_id = q.query_id AND a.term = q.term AND q.doc_id IS NULL
WHERE a.doc_id IS NOT NULL GROUP BY a.query_id, a.doc_id HAVING sum(a.u * q.u) > 0.1"""
)
def tfidf_relevance(spark, sf_dir):
    docs, asked = st.table(spark, sf_dir, "documents"), st.questions(spark, sf_dir)
    top = sparse.bm25_topk(docs, asked, 10).select("query_id", "doc_id")
    n = asked.count()
    pairs = sparse.small(top, 10 * n).join(docs.select("doc_id", "text"), "doc_id").select("query_id", "doc_id", "text")
    pairs = pairs.union(asked.select("query_id", F.lit(None).cast("long"), "text"))
    return sparse.tfidf_relevance(pairs).select("query_id", "doc_id", r6("relevance").alias("relevance"))


@query("SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))")
def substring_match(spark, sf_dir):
    return sparse.phrase_matches(st.table(spark, sf_dir, "documents"), st.questions(spark, sf_dir))


_CENTROIDS = """parts AS (SELECT label, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)),
centroids AS (SELECT label AS query_id, list(x ORDER BY i) AS query FROM (SELECT label, i, avg(x) AS x FROM parts GROUP BY label, i) GROUP BY label),
scores AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], query) AS score FROM embeddings, centroids)"""


@query(
    f"""WITH {_CENTROIDS}, ranked AS (SELECT query_id, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS INTEGER) AS rank FROM scores WHERE score >= 0.3)
SELECT query_id, vec_id, score, rank FROM ranked WHERE rank <= 10"""
)
def dense_topk(spark, sf_dir):
    vectors = st.table(spark, sf_dir, "embeddings")
    return dense.topk(vectors, dense.centroids(vectors)).select("query_id", "vec_id", "score", "rank")


@query(f"WITH {_CENTROIDS} SELECT query_id, count(*) AS n, round(min(score), 6) AS least, round(max(score), 6) AS largest FROM scores WHERE score >= 0.3 GROUP BY query_id")
def dense_threshold(spark, sf_dir):
    vectors = st.table(spark, sf_dir, "embeddings")
    found = dense.cosine_scores(vectors, dense.centroids(vectors))
    return found.groupBy("query_id").agg(F.count("*").alias("n"), r6(F.min("score")).alias("least"), r6(F.max("score")).alias("largest"))


@query("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS score FROM embeddings")
def dense_cosine(spark, sf_dir):
    return st.table(spark, sf_dir, "embeddings").select("vec_id", r6(cosine(F.col("embedding"), F.reverse("embedding"))).alias("score"))


# -- graph

_RECIPROCAL = "CASE rel_type WHEN 'CHILDOF' THEN 'PARENTOF' WHEN 'CANPRECEDE' THEN 'CANFOLLOW' WHEN 'REQUIRES' THEN 'REQUIREDBY' END"
_BOTH = f"both_ways AS (SELECT src, dst, rel_type FROM edges UNION SELECT dst, src, {_RECIPROCAL} FROM edges WHERE {_RECIPROCAL} IS NOT NULL)"
_ENDS = "ends AS (SELECT src AS id, dst AS other, rel_type FROM edges UNION ALL SELECT dst, src, rel_type FROM edges)"


@query(f"WITH {ALL_EDGES_SQL}, {_BOTH} SELECT src, dst, rel_type FROM both_ways")
def reciprocal_edges(spark, sf_dir):
    return graph.with_reciprocals(st.all_edges(spark, sf_dir))


@query(f"WITH {ALL_EDGES_SQL}, {_BOTH} SELECT rel_type, count(*) AS n_edges FROM both_ways GROUP BY rel_type")
def relation_counts(spark, sf_dir):
    return graph.relation_counts(graph.with_reciprocals(st.all_edges(spark, sf_dir)))


@query(f"WITH {ALL_EDGES_SQL}, {_ENDS} SELECT id, count(*) AS degree FROM ends GROUP BY id ORDER BY degree DESC, id LIMIT 20")
def node_degree_topk(spark, sf_dir):
    return graph.degrees(st.all_edges(spark, sf_dir)).orderBy(F.desc("degree"), "id").limit(20)


@query(f"WITH {ALL_EDGES_SQL}, {_ENDS} SELECT id, count(DISTINCT rel_type) AS n_types, count(*) AS n_relations, round(least(0.3::DOUBLE, 0.1::DOUBLE * count(DISTINCT rel_type) + 0.005::DOUBLE * count(*)), 6) AS score FROM ends GROUP BY id")
def richness(spark, sf_dir):
    return graph.richness(st.all_edges(spark, sf_dir)).withColumn("score", r6("score"))


@query(f"WITH {GRAPH_SQL} SELECT type, count(*) AS n_nodes FROM nodes GROUP BY type")
def graph_metadata(spark, sf_dir):
    return st.nodes(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n_nodes"))


def _bfs_sql(moves: str, seeds: str, depth: int) -> str:
    """CTEs up to ``found`` (seed, node, level, weight); moves: src, dst, w; seeds: seed, node."""
    return f"""moves AS (SELECT src, dst, max(w) AS w FROM ({moves}) GROUP BY src, dst),
walk AS (SELECT seed, node, 0 AS level FROM ({seeds}) UNION ALL SELECT seed, dst, level + 1 FROM walk JOIN moves ON src = node WHERE level < {depth}),
levels AS (SELECT seed, node, min(level) AS level FROM walk GROUP BY seed, node),
found AS (SELECT l.seed, l.node, l.level, max(m.w) AS weight FROM levels l JOIN moves m ON m.dst = l.node JOIN levels p ON p.seed = l.seed AND p.node = m.src AND p.level = l.level - 1 GROUP BY l.seed, l.node, l.level)"""


def _either(table: str, w: str = "1.0") -> str:
    return f"SELECT src, dst, {w}::DOUBLE AS w FROM {table} UNION ALL SELECT dst, src, {w}::DOUBLE FROM {table}"


_SEED_TYPES = "SELECT seed, seed AS node FROM event_types"


@query(
    f"""WITH RECURSIVE {GRAPH_SQL}, {_bfs_sql(_either('hierarchy', '0.3'), "SELECT id AS seed, id AS node FROM nodes WHERE type = 'Pillar'", 3)}
SELECT seed, node, level, round(weight * greatest(0.5::DOUBLE, 1 - 0.2::DOUBLE * (level - 1)), 6) AS score FROM found"""
)
def bfs_explicit(spark, sf_dir):
    seeds = st.nodes(spark, sf_dir).where("type = 'Pillar'").select(F.col("id").alias("seed"), F.col("id").alias("node"))
    return graph.explicit_seeds(st.hierarchy(spark, sf_dir), seeds).withColumn("score", r6("score"))


_PARENTS = "parents AS (SELECT src, min(dst) AS dst FROM hierarchy GROUP BY src)"


@query(
    f"""WITH RECURSIVE {GRAPH_SQL}, {_PARENTS}, up AS (
  SELECT id AS node, id AS spot, 0 AS level FROM nodes WHERE type IN ('Variant', 'Base') UNION ALL SELECT node, dst, level + 1 FROM up JOIN parents ON src = spot WHERE level < 3)
SELECT node, spot AS ancestor, level, round(0.8::DOUBLE * pow(0.7::DOUBLE, level), 6) AS score FROM up WHERE level > 0"""
)
def abstraction_up(spark, sf_dir):
    return graph.abstraction_up(st.nodes(spark, sf_dir), st.hierarchy(spark, sf_dir)).withColumn("score", r6("score"))


@query(
    f"""WITH RECURSIVE {GRAPH_SQL}, down AS (
  SELECT id AS seed, id AS node, 0 AS level FROM nodes WHERE type IN ('Class', 'Pillar', 'Base') UNION ALL SELECT seed, src, level + 1 FROM down JOIN hierarchy ON dst = node WHERE level < 2)
SELECT seed AS node, node AS descendant, min(level) AS level, round(any_value(CASE type WHEN 'Base' THEN 0.9::DOUBLE WHEN 'Variant' THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END) * pow(0.8::DOUBLE, min(level)), 6) AS score
FROM down JOIN nodes ON id = node GROUP BY seed, node"""
)
def abstraction_down(spark, sf_dir):
    return graph.abstraction_down(st.nodes(spark, sf_dir), st.hierarchy(spark, sf_dir)).withColumn("score", r6("score"))


@query(f"WITH RECURSIVE {GRAPH_SQL}, {_bfs_sql('SELECT src, dst, 1.0::DOUBLE AS w FROM sequences', _SEED_TYPES, 3)} SELECT seed, node, level, round(weight * pow(0.8::DOUBLE, level - 1), 6) AS score FROM found")
def seq_forward(spark, sf_dir):
    return graph.sequence_forward(st.sequences(spark, sf_dir), st.event_types(spark, sf_dir)).withColumn("score", r6("score"))


@query(f"WITH RECURSIVE {GRAPH_SQL}, {_bfs_sql('SELECT dst AS src, src AS dst, 1.0::DOUBLE AS w FROM sequences', _SEED_TYPES, 3)} SELECT seed, node, level, round(pow(0.8::DOUBLE, level - 1), 6) AS score FROM found")
def seq_backward(spark, sf_dir):
    return graph.sequence_backward(st.sequences(spark, sf_dir), st.event_types(spark, sf_dir)).withColumn("score", r6("score"))


_SEED_PARTS = "SELECT 'P' || p_partkey AS seed, 'P' || p_partkey AS node FROM part"


@query(f"WITH RECURSIVE {GRAPH_SQL}, {_bfs_sql(_either('likes'), _SEED_PARTS, 2)} SELECT seed, node, level, round(0.9::DOUBLE * pow(0.7::DOUBLE, level - 1), 6) AS score FROM found")
def peer_expand(spark, sf_dir):
    part = st.table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("seed"))
    return graph.peers(st.likes(spark, sf_dir), part.withColumn("node", F.col("seed"))).withColumn("score", r6("score"))


@query(f"WITH RECURSIVE {GRAPH_SQL}, {_bfs_sql('SELECT src, dst, 1.0::DOUBLE AS w FROM sequences', _SEED_TYPES, 3)} SELECT seed, node, level, 'consequence_depth_' || level AS role, round(0.9::DOUBLE - 0.1::DOUBLE * (level - 1), 6) AS score FROM found")
def chain_progression(spark, sf_dir):
    return graph.chain_progression(st.sequences(spark, sf_dir), st.event_types(spark, sf_dir)).withColumn("score", r6("score"))


@query(
    f"""WITH RECURSIVE {GRAPH_SQL}, {_PARENTS}, up AS (SELECT id AS node, id AS spot, '' AS chain, 0 AS n FROM nodes UNION ALL SELECT node, dst, chain || CASE WHEN n > 0 THEN ',' ELSE '' END || dst, n + 1 FROM up JOIN parents ON src = spot WHERE NOT contains(',' || chain || ',', ',' || dst || ','))
SELECT node, arg_max(chain, n) AS chain FROM up WHERE n > 0 GROUP BY node"""
)
def ancestor_chain(spark, sf_dir):
    return graph.ancestor_chain(st.nodes(spark, sf_dir), st.hierarchy(spark, sf_dir)).select("node", listed("chain").alias("chain"))


@query(f"WITH RECURSIVE {GRAPH_SQL}, {_bfs_sql('SELECT src, dst, 1.0::DOUBLE AS w FROM sequences', _SEED_TYPES, 3)} SELECT seed, string_agg(node, ',' ORDER BY level, node) AS reached FROM found GROUP BY seed")
def precede_closure(spark, sf_dir):
    found = graph.bfs(graph.steps(st.sequences(spark, sf_dir), GRAPH.forward), st.event_types(spark, sf_dir), 3)
    rows = found.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("level", "node"))).alias("l"))
    return rows.select("seed", listed(F.transform("l", lambda x: x["node"])).alias("reached"))


@query("SELECT 'P' || p_partkey AS node, 'P' || min(p_partkey::VARCHAR) OVER (PARTITION BY p_brand, p_size) AS \"group\" FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, p_size) > 1")
def peer_groups(spark, sf_dir):
    return graph.groups_of(st.likes(spark, sf_dir))


@query(
    f"""WITH {GRAPH_SQL} SELECT v.id AS variant, b.id AS base, c.id AS class, p.id AS pillar FROM nodes v JOIN hierarchy h1 ON h1.src = v.id JOIN nodes b ON b.id = h1.dst AND b.type = 'Base'
JOIN hierarchy h2 ON h2.src = b.id JOIN nodes c ON c.id = h2.dst AND c.type = 'Class' JOIN hierarchy h3 ON h3.src = c.id JOIN nodes p ON p.id = h3.dst AND p.type = 'Pillar' WHERE v.type = 'Variant'"""
)
def abstraction_table(spark, sf_dir):
    return graph.abstraction_table(st.nodes(spark, sf_dir), st.hierarchy(spark, sf_dir))


@query(f"WITH {ALL_EDGES_SQL} SELECT DISTINCT src AS node, dst AS other FROM edges WHERE rel_type IN ('CHILDOF', 'CANPRECEDE') UNION SELECT dst, src FROM edges WHERE rel_type IN ('CHILDOF', 'CANPRECEDE')")
def related_nodes(spark, sf_dir):
    return graph.related(st.all_edges(spark, sf_dir), ("CHILDOF", "CANPRECEDE"), "both")


@query(
    f"""WITH {ALL_EDGES_SQL}, {_BOTH}, roles AS (
  SELECT src AS node, dst AS other, 'child' AS role FROM both_ways WHERE rel_type = 'PARENTOF' UNION SELECT src, dst, 'parent' FROM both_ways WHERE rel_type = 'CHILDOF'
  UNION SELECT src, dst, 'peer' FROM both_ways WHERE rel_type = 'PEEROF' UNION SELECT dst, src, 'peer' FROM both_ways WHERE rel_type = 'PEEROF'
  UNION SELECT src, dst, 'prerequisite' FROM both_ways WHERE rel_type = 'CANFOLLOW' UNION SELECT src, dst, 'consequence' FROM both_ways WHERE rel_type = 'CANPRECEDE')
SELECT node, role, count(*) AS n FROM roles GROUP BY node, role"""
)
def abstraction_advice(spark, sf_dir):
    return graph.advice(graph.with_reciprocals(st.all_edges(spark, sf_dir))).groupBy("node", "role").agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {GRAPH_SQL}, {_bfs_sql('SELECT src, dst, 1.0::DOUBLE AS w FROM sequences', _SEED_TYPES, 3)}
SELECT seed, node, level, CASE WHEN level = 0 THEN 'ROOT' ELSE 'EFFECT' END AS position FROM levels"""
)
def vulnerability_chain(spark, sf_dir):
    return graph.chain_positions(st.sequences(spark, sf_dir), st.event_types(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {GRAPH_SQL}, {_bfs_sql(_either('hierarchy'), "SELECT id AS seed, id AS node FROM nodes WHERE type = 'Class'", 2)},
inside AS (SELECT DISTINCT a.seed, h.src, h.dst FROM hierarchy h JOIN levels a ON a.node = h.src JOIN levels b ON b.node = h.dst AND b.seed = a.seed)
SELECT seed, n_nodes, n_edges FROM (SELECT seed, count(*) AS n_nodes FROM levels GROUP BY seed) JOIN (SELECT seed, count(*) AS n_edges FROM inside GROUP BY seed) USING (seed)"""
)
def k_hop_subgraph(spark, sf_dir):
    seeds = st.nodes(spark, sf_dir).where("type = 'Class'").select(F.col("id").alias("seed"), F.col("id").alias("node"))
    found, inside = graph.neighbourhood(st.hierarchy(spark, sf_dir), seeds)
    n = lambda rows, name: rows.groupBy("seed").agg(F.count("*").alias(name))
    return n(found, "n_nodes").join(n(inside, "n_edges"), "seed")


_STRATEGIES = f"""{_bfs_sql('SELECT src, dst, 1.0::DOUBLE AS w FROM sequences', _SEED_TYPES, 3)},
strategies AS (
  SELECT seed AS query_id, node, 'sequence_path' AS strategy, weight * pow(0.8::DOUBLE, level - 1) AS score FROM found
  UNION ALL SELECT seed, node, 'vulnerability_chain', 0.9::DOUBLE - 0.1::DOUBLE * (level - 1) FROM found
  UNION ALL SELECT seed, seed, 'explicit_mention', 1.0::DOUBLE FROM event_types
), total AS (
  SELECT query_id, node, sum(part) AS score, arg_max(strategy, part) AS strongest FROM (
    SELECT query_id, node, strategy, max(score * CASE strategy WHEN 'sequence_path' THEN 0.8::DOUBLE WHEN 'vulnerability_chain' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END) AS part FROM strategies GROUP BY ALL)
  GROUP BY query_id, node HAVING sum(part) >= 0.05
)"""


def _strategies(spark, sf_dir) -> DataFrame:
    edges, seeds = st.sequences(spark, sf_dir), st.event_types(spark, sf_dir)
    named = lambda rows, name: rows.select(F.col("seed").alias("query_id"), "node", F.lit(name).alias("strategy"), F.col("score").cast("double").alias("score"))
    rows = named(graph.sequence_forward(edges, seeds), "sequence_path").union(named(graph.chain_progression(edges, seeds), "vulnerability_chain"))
    return rows.union(named(seeds.withColumn("score", F.lit(1.0)), "explicit_mention"))


def _typed_events(spark, sf_dir) -> DataFrame:
    return st.event_types(spark, sf_dir).select(F.col("node").alias("id"), st.kind_of(F.length("node")).alias("type"))


@query(
    f"""WITH RECURSIVE {GRAPH_SQL}, {_STRATEGIES}, final AS (
  SELECT query_id, node, strongest, round(score * CASE {KIND_SQL.format('length(node)')} WHEN 'Base' THEN 1.3::DOUBLE WHEN 'Variant' THEN 1.2::DOUBLE WHEN 'Class' THEN 0.8::DOUBLE WHEN 'Pillar' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM total)
SELECT query_id, node, strongest, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS INTEGER) AS rank FROM final QUALIFY rank <= 10"""
)
def strategy_combine(spark, sf_dir):
    return graph.combined(_strategies(spark, sf_dir), _typed_events(spark, sf_dir)).select("query_id", "node", "strongest", "score", "rank")


@query(
    f"""WITH {HITS_SQL}, g AS (SELECT query_id, entry_id AS node, max(least(score / 2.8::DOUBLE, 1.0)) AS g FROM hits WHERE retriever = 'graph' GROUP BY 1, 2), v AS (SELECT query_id, entry_id AS node, max(least(score, 1.0)) AS v FROM hits WHERE retriever = 'dense' GROUP BY 1, 2),
f AS (SELECT query_id, node, round(CASE WHEN g IS NOT NULL AND v IS NOT NULL THEN 0.6::DOUBLE * g + 0.4::DOUBLE * v ELSE coalesce(g, v) END, 6) AS score, concat_ws('+', CASE WHEN g IS NOT NULL THEN 'graph' END, CASE WHEN v IS NOT NULL THEN 'vector' END) AS sources FROM g FULL JOIN v USING (query_id, node))
SELECT query_id, node, score, sources, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS INTEGER) AS rank FROM f"""
)
def vector_graph_combine(spark, sf_dir):
    rows = fusion.best_hits(st.hits(spark, sf_dir)).withColumn("score", normalized(F.col("retriever"), F.col("score")))
    of = lambda r: rows.where(F.col("retriever") == r).select("query_id", F.col("entry_id").alias("node"), "score")
    return graph.vector_graph(of("graph"), of("dense"))


@query(None)
def betweenness(spark, sf_dir):
    edges = st.hierarchy(spark, sf_dir)
    return graph.betweenness(edges.union(graph.steps(edges, way="in"))).withColumn("betweenness", r6("betweenness"))


@query(
    f"""WITH RECURSIVE {GRAPH_SQL}, {_bfs_sql(_either('hierarchy'), "SELECT id AS seed, id AS node FROM nodes WHERE type = 'Class'", 1)},
lines AS (
  SELECT seed, 0 AS part, '    ' || id || '["' || replace(CASE WHEN length(name) > 25 THEN name[1:22] || '...' ELSE name END, '"', chr(39)) || '"]' AS line FROM levels JOIN nodes ON id = node
  UNION SELECT a.seed, 1, '    ' || h.src || ' -->|' || lower(h.rel_type) || '| ' || h.dst FROM hierarchy h JOIN levels a ON a.node = h.src JOIN levels b ON b.node = h.dst AND b.seed = a.seed
)
SELECT seed, 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY part, line) AS diagram FROM lines GROUP BY seed"""
)
def mermaid(spark, sf_dir):
    nodes, edges = st.nodes(spark, sf_dir), st.hierarchy(spark, sf_dir)
    seeds = nodes.where("type = 'Class'").select(F.col("id").alias("seed"), F.col("id").alias("node"))
    found, inside = graph.neighbourhood(edges, seeds, depth=1)
    return graph.mermaid(found.join(nodes.withColumnRenamed("id", "node"), "node").select("seed", F.col("node").alias("id"), "name"), inside)


# -- fusion

_NORM = "least(score / CASE retriever WHEN 'sparse' THEN 1250.0::DOUBLE WHEN 'graph' THEN 2.8::DOUBLE ELSE 1.0::DOUBLE END, 1.0)"
_WEIGHT = "CASE retriever WHEN 'dense' THEN 0.35::DOUBLE WHEN 'sparse' THEN 0.4::DOUBLE ELSE 0.25::DOUBLE END"
_FUSED = f"""{HITS_SQL}, {ENTRIES_SQL}, best AS (SELECT query_id, entry_id, retriever, max(score) AS score FROM hits GROUP BY ALL),
normed AS (SELECT *, {_NORM} AS norm, {_NORM} * {_WEIGHT} AS part FROM best),
wide AS (
  SELECT query_id, entry_id, coalesce(max(part) FILTER (retriever = 'dense'), 0) AS d, coalesce(max(part) FILTER (retriever = 'sparse'), 0) AS s, coalesce(max(part) FILTER (retriever = 'graph'), 0) AS g,
    string_agg(retriever, '+' ORDER BY retriever) AS found_by FROM normed GROUP BY query_id, entry_id
), fused AS (
  SELECT query_id, entry_id, found_by, d, s, g, round((d + s + g)
    * CASE abstraction WHEN 'Base' THEN 1.3::DOUBLE WHEN 'Variant' THEN 1.2::DOUBLE WHEN 'Class' THEN 0.8::DOUBLE WHEN 'Pillar' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END
    * CASE WHEN found_by = 'graph' AND n_relations > 0 THEN 1 + least(0.15::DOUBLE * n_relations, 0.45::DOUBLE) ELSE 1.0::DOUBLE END
    * CASE usage WHEN 'Allowed' THEN 1.1::DOUBLE WHEN 'Allowed-with-Review' THEN 1.05::DOUBLE WHEN 'Discouraged' THEN 0.8::DOUBLE WHEN 'Prohibited' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score
  FROM wide JOIN entries USING (entry_id)
)"""
_RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS INTEGER) AS rank"


@query(f"WITH {HITS_SQL} SELECT retriever, count(*) AS n, round(min({_NORM}), 6) AS least, round(max({_NORM}), 6) AS largest, round(avg({_NORM}), 6) AS mean FROM hits GROUP BY retriever")
def normalize_scores(spark, sf_dir):
    n = normalized(F.col("retriever"), F.col("score"))
    rows = st.hits(spark, sf_dir).select("retriever", n.alias("norm"))
    return rows.groupBy("retriever").agg(F.count("*").alias("n"), r6(F.min("norm")).alias("least"), r6(F.max("norm")).alias("largest"), r6(F.avg("norm")).alias("mean"))


@query(f"WITH {_FUSED} SELECT query_id, entry_id, found_by, score, {_RANK} FROM fused")
def fuse_hits(spark, sf_dir):
    rows = fusion.fuse(st.hits(spark, sf_dir), F.broadcast(st.entries(spark, sf_dir)))
    return rows.select("query_id", "entry_id", F.array_join("retrievers", "+").alias("found_by"), "score", "rank")


@query(f"WITH {_FUSED} SELECT query_id, entry_id, score, {_RANK} FROM fused WHERE found_by LIKE '%sparse%'")
def fuse_sparse_gated(spark, sf_dir):
    return fusion.fuse(st.hits(spark, sf_dir), F.broadcast(st.entries(spark, sf_dir)), mode="sparse_gated").select("query_id", "entry_id", "score", "rank")


@query(f"WITH {_FUSED} SELECT query_id, entry_id, round(d / t * 100, 6) AS dense_pct, round(s / t * 100, 6) AS sparse_pct, round(g / t * 100, 6) AS graph_pct FROM (SELECT *, CASE WHEN d + s + g > 0 THEN d + s + g ELSE 1.0 END AS t FROM wide)")
def contribution_pct(spark, sf_dir):
    rows = fusion.contributions(fusion.provenance(st.hits(spark, sf_dir)))
    return rows.select("query_id", "entry_id", *[r6(f"{r}_pct").alias(f"{r}_pct") for r in fusion.RETRIEVERS])


@query(f"WITH {HITS_SQL} SELECT query_id, entry_id, score, retriever FROM (SELECT *, row_number() OVER (PARTITION BY query_id, entry_id ORDER BY score DESC, retriever) AS n FROM hits) WHERE n = 1")
def dedupe_keep_max(spark, sf_dir):
    return fusion.dedupe_keep_max(st.hits(spark, sf_dir))


@query(f"WITH {HITS_SQL} SELECT retriever, count(*) AS n, round(min(score), 6) AS least, round(max(score), 6) AS largest, round(avg(score), 6) AS mean, round(median(score), 6) AS median FROM hits GROUP BY retriever")
def score_stats(spark, sf_dir):
    rows = fusion.score_statistics(st.hits(spark, sf_dir))
    return rows.select("retriever", "n", *[r6(c).alias(c) for c in ("least", "largest", "mean", "median")])


@query(f"WITH {HITS_SQL} SELECT query_id, retriever, round(max(score) - min(score), 6) AS spread FROM hits GROUP BY query_id, retriever")
def score_ranges(spark, sf_dir):
    return fusion.score_ranges(st.hits(spark, sf_dir)).groupBy("query_id", "retriever").agg(r6(F.max("largest") - F.min("least")).alias("spread"))


@query(f"WITH {_FUSED} SELECT found_by, count(*) AS n_entries FROM wide GROUP BY found_by")
def overlap_breakdown(spark, sf_dir):
    return fusion.overlap(st.hits(spark, sf_dir))


@query(f"WITH {_FUSED} SELECT retriever, count(*) AS hits, round(avg(norm), 6) AS mean_norm, count(*) FILTER (n = 1) AS unique_finds FROM (SELECT *, count(*) OVER (PARTITION BY query_id, entry_id) AS n FROM normed) GROUP BY retriever")
def retriever_effectiveness(spark, sf_dir):
    return fusion.effectiveness(st.hits(spark, sf_dir)).withColumn("mean_norm", r6("mean_norm"))


@query(
    f"""SELECT doc_id, {KIND_SQL.format('doc_id')} AS abstraction, {USAGE_SQL.format('doc_id')} AS usage,
round(CASE doc_id % 5 WHEN 0 THEN 0.6 WHEN 1 THEN 0.8 WHEN 2 THEN 1.3 WHEN 3 THEN 1.2 ELSE 1.0 END::DOUBLE * CASE doc_id % 4 WHEN 0 THEN 1.1 WHEN 1 THEN 1.05 WHEN 2 THEN 0.8 ELSE 0.5 END::DOUBLE, 6) AS factor FROM documents"""
)
def mapping_enrich(spark, sf_dir):
    d = F.col("doc_id")
    rows = st.table(spark, sf_dir, "documents").select("doc_id", st.kind_of(d).alias("abstraction"), st.usage_of(d).alias("usage"))
    return rows.withColumn("factor", r6(abstraction_factor(F.col("abstraction")) * usage_factor(F.col("usage"))))


@query(f"WITH {_FUSED} SELECT query_id, CAST(count(*) AS INTEGER) AS results_count, string_agg(entry_id || '=' || rank, ',' ORDER BY rank) AS results FROM (SELECT *, {_RANK} FROM fused) WHERE rank <= 3 GROUP BY query_id")
def consolidated_topk(spark, sf_dir):
    rows = fusion.consolidated(fusion.fuse(st.hits(spark, sf_dir), F.broadcast(st.entries(spark, sf_dir)), 3), 3)
    return rows.select("query_id", "results_count", listed(F.transform("results", lambda r: F.concat_ws("=", r["entry_id"], r["rank"]))).alias("results"))


# -- consensus

@query(f"WITH {VOTES_SQL} SELECT record_id, arg_max(entry_id, (votes, -first_pos)) AS consensus, CAST(max(votes) AS BIGINT) AS votes FROM (SELECT record_id, entry_id, sum(frequency) AS votes, min(pos) AS first_pos FROM votes GROUP BY 1, 2) GROUP BY record_id")
def consensus_vote(spark, sf_dir):
    return consensus.consensus(st.votes(spark, sf_dir))


@query(
    f"""WITH {VOTES_SQL} SELECT record_id, similarity, CAST(row_number() OVER (PARTITION BY record_id, similarity ORDER BY votes DESC, first_pos) AS INTEGER) AS rank, entry_id, votes
FROM (SELECT record_id, similarity, entry_id, CAST(sum(frequency) AS BIGINT) AS votes, min(pos) AS first_pos FROM votes GROUP BY 1, 2, 3) QUALIFY rank <= 3"""
)
def top3_per_threshold(spark, sf_dir):
    return consensus.top_per_similarity(st.votes(spark, sf_dir))


@query(
    f"""WITH {VOTES_SQL}, t AS (SELECT record_id, entry_id, CASE WHEN similarity >= 95 THEN 'high' WHEN similarity >= 85 THEN 'medium' ELSE 'low' END AS tier, min((-similarity, pos)) AS spot FROM votes GROUP BY 1, 2, 3)
SELECT record_id, coalesce(string_agg(entry_id, ',' ORDER BY spot) FILTER (tier = 'high'), '') AS high, coalesce(string_agg(entry_id, ',' ORDER BY spot) FILTER (tier = 'medium'), '') AS medium, coalesce(string_agg(entry_id, ',' ORDER BY spot) FILTER (tier = 'low'), '') AS low FROM t GROUP BY record_id"""
)
def confidence_tiers(spark, sf_dir):
    return consensus.tiers(st.votes(spark, sf_dir)).select("record_id", *[listed(c).alias(c) for c in ("high", "medium", "low")])


@query(f"WITH {VOTES_SQL} SELECT record_id, CAST(sum(total) AS BIGINT) AS total FROM (SELECT record_id, similarity, arg_min(total, pos) AS total FROM votes GROUP BY 1, 2) GROUP BY record_id")
def vote_totals(spark, sf_dir):
    return consensus.totals(st.votes(spark, sf_dir))


# -- usage and cost

_SUMS = ", ".join(f"CAST(sum({m}) AS BIGINT) AS sum_{m}" for m in usage.MEASURES)


@query(
    f"""WITH {USAGE_LOG_SQL} SELECT stage, count(*) AS n, {_SUMS}, {', '.join(f'round(avg({m}), 6) AS avg_{m}' for m in usage.MEASURES)},
{', '.join(f'{f}({m}) AS {f}_{m}' for m in ('input_length', 'output_length') for f in ('min', 'max'))} FROM log GROUP BY stage"""
)
def usage_by_stage(spark, sf_dir):
    return usage.by_stage(st.usage_log(spark, sf_dir)).withColumns({f"avg_{m}": r6(f"avg_{m}") for m in usage.MEASURES})


@query(f"WITH {USAGE_LOG_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY record_id, stage ORDER BY pos DESC) AS n FROM log) SELECT record_id, count(*) AS stages, {_SUMS} FROM l WHERE n = 1 GROUP BY record_id")
def usage_by_record(spark, sf_dir):
    return usage.by_record(st.usage_log(spark, sf_dir))


@query(f"WITH {USAGE_LOG_SQL} SELECT stage, record_id, CAST(grouping(stage, record_id) AS INTEGER) AS level, count(*) AS n, {_SUMS} FROM log GROUP BY GROUPING SETS ((stage), (record_id), ())")
def usage_grouping_sets(spark, sf_dir):
    return usage.all_levels(st.usage_log(spark, sf_dir))


@query(
    f"""WITH {USAGE_LOG_SQL}, r AS (SELECT record_id, sum(input_words) AS i, sum(output_words) AS o FROM log GROUP BY record_id)
SELECT record_id, CAST(trunc(i / 0.75::DOUBLE) AS BIGINT) AS input_tokens, CAST(trunc(o / 0.75::DOUBLE) AS BIGINT) AS output_tokens, round(i / 0.75::DOUBLE / 1000 * 0.0001::DOUBLE + o / 0.75::DOUBLE / 1000 * 0.0004::DOUBLE, 6) AS cost
FROM r ORDER BY cost DESC, record_id LIMIT 10"""
)
def cost_topk(spark, sf_dir):
    sums = st.usage_log(spark, sf_dir).groupBy("record_id").agg(F.sum("input_words").alias("sum_input_words"), F.sum("output_words").alias("sum_output_words"))
    rows = usage.priced(sums).select("record_id", "input_tokens", "output_tokens", r6("cost").alias("cost"))
    return rows.orderBy(F.desc("cost"), "record_id").limit(10)


# -- extraction and evaluation

_RESULT_IDS = "SELECT l_orderkey AS record_id, CAST(l_suppkey % 50 AS VARCHAR) AS entry_id, CASE WHEN l_linenumber % 2 = 0 THEN 'even' ELSE 'odd' END AS source FROM lineitem WHERE l_returnflag <> 'R'"
_TRUE_IDS = "SELECT l_orderkey AS record_id, CAST(l_suppkey % 50 AS VARCHAR) AS entry_id FROM lineitem WHERE l_linestatus = 'O'"


def _answers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Order lines as given answers (not returned) and as true ones (open)."""
    rows = st.table(spark, sf_dir, "lineitem").withColumn("entry_id", (F.col("l_suppkey") % 50).cast("string")).withColumn("record_id", F.col("l_orderkey"))
    given = rows.where("l_returnflag <> 'R'").select("record_id", "entry_id", F.when(F.col("l_linenumber") % 2 == 0, "even").otherwise("odd").alias("source"))
    return given, rows.where("l_linestatus = 'O'").select("record_id", "entry_id")


def _id_sets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("record_id").agg(F.collect_set("entry_id").alias("ids"))


_ANSWERS = f"given AS ({_RESULT_IDS}), truth AS ({_TRUE_IDS})"
_COMPARED = f"""{_ANSWERS}, g AS (SELECT record_id, list_distinct(list(entry_id)) AS ids FROM given GROUP BY 1), t AS (SELECT record_id, list_distinct(list(entry_id)) AS ids FROM truth GROUP BY 1),
compared AS (SELECT record_id, t.ids IS NOT NULL AS in_truth, list_sort(list_intersect(g.ids, coalesce(t.ids, []))) AS matched, list_sort(list_filter(coalesce(t.ids, []), lambda x: NOT list_contains(g.ids, x))) AS truth_only, list_sort(list_filter(g.ids, lambda x: NOT list_contains(coalesce(t.ids, []), x))) AS results_only FROM g LEFT JOIN t USING (record_id))"""


def _compared(spark, sf_dir) -> DataFrame:
    given, truth = _answers(spark, sf_dir)
    return evaluate.compared(_id_sets(given), _id_sets(truth))


@query(f"WITH {_COMPARED} SELECT record_id, in_truth, array_to_string(matched, ';') AS matched, array_to_string(truth_only, ';') AS truth_only, array_to_string(results_only, ';') AS results_only FROM compared")
def benchmark_compare(spark, sf_dir):
    return _compared(spark, sf_dir).select("record_id", "in_truth", *[F.array_join(c, ";").alias(c) for c in ("matched", "truth_only", "results_only")])


@query(
    f"""WITH {_COMPARED} SELECT count(*) AS n_records, count(*) FILTER (in_truth) AS n_in_truth, count(*) FILTER (in_truth AND len(matched) > 0) AS n_matching, CAST(coalesce(sum(len(matched)), 0) AS BIGINT) AS n_matched_ids,
round(count(*) FILTER (in_truth) * 100.0::DOUBLE / nullif(count(*), 0), 6) AS coverage_pct, round(count(*) FILTER (in_truth AND len(matched) > 0) * 100.0::DOUBLE / nullif(count(*) FILTER (in_truth), 0), 6) AS match_pct FROM compared"""
)
def benchmark_summary(spark, sf_dir):
    rows = evaluate.comparison_summary(_compared(spark, sf_dir))
    return rows.withColumns({c: r6(F.col(c).cast("double")) for c in ("coverage_pct", "match_pct")})


@query(f"WITH given AS ({_RESULT_IDS}), truth AS ({_TRUE_IDS}) SELECT source, count(*) FILTER (hit) AS matches, count(*) AS total, count(DISTINCT record_id) AS records FROM (SELECT DISTINCT * FROM given) LEFT JOIN (SELECT DISTINCT *, true AS hit FROM truth) USING (record_id, entry_id) GROUP BY source")
def benchmark_by_source(spark, sf_dir):
    return evaluate.by_source(*_answers(spark, sf_dir))


@query(f"WITH {_COMPARED} SELECT record_id, CAST(len(list_distinct(list_concat(g.ids, t.ids))) AS INTEGER) AS n_union, CAST(len(list_intersect(g.ids, t.ids)) AS INTEGER) AS n_both, CAST(len(list_filter(g.ids, lambda x: NOT list_contains(t.ids, x))) AS INTEGER) AS n_except FROM g JOIN t USING (record_id)")
def set_union_intersect_except(spark, sf_dir):
    given, truth = (_id_sets(x) for x in _answers(spark, sf_dir))
    rows = given.join(truth.withColumnRenamed("ids", "t"), "record_id")
    return rows.select("record_id", F.size(F.array_union("ids", "t")).alias("n_union"), F.size(F.array_intersect("ids", "t")).alias("n_both"), F.size(F.array_except("ids", "t")).alias("n_except"))


_CONFUSION = "sum(CASE WHEN p AND toxic = 1 THEN 1 ELSE 0 END)::DOUBLE AS tp, sum(CASE WHEN p AND toxic = 0 THEN 1 ELSE 0 END)::DOUBLE AS fp, sum(CASE WHEN NOT p AND toxic = 1 THEN 1 ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN NOT p AND toxic = 0 THEN 1 ELSE 0 END)::DOUBLE AS tn"


@query(
    f"""WITH c AS (SELECT lang, {_CONFUSION} FROM (SELECT lang, toxic, regexp_matches(lower(text), 'idiot|moron|stupid|loser') AS p FROM documents JOIN labels USING (doc_id)) GROUP BY lang)
SELECT lang, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c"""
)
def precision_recall_f1(spark, sf_dir):
    said = F.lower("text").rlike("idiot|moron|stupid|loser")
    rows = st.table(spark, sf_dir, "documents").select("doc_id", "lang", said.alias("p")).join(st.table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    t = F.col("toxic") == 1
    counts = rows.groupBy("lang").agg(F.count_if(F.col("p") & t).alias("tp"), F.count_if(F.col("p") & ~t).alias("fp"), F.count_if(~F.col("p") & t).alias("fn"), F.count_if(~F.col("p") & ~t).alias("tn"))
    return evaluate.rates(counts).withColumns({c: r6(c) for c in ("accuracy", "precision", "recall", "f1")})


@query(f"WITH g AS (SELECT record_id, list_distinct(list(entry_id)) AS ids FROM ({_RESULT_IDS}) GROUP BY 1) SELECT entry_id, count(*) AS n FROM (SELECT unnest(ids) AS entry_id FROM g) GROUP BY entry_id ORDER BY n DESC, entry_id LIMIT 10")
def common_ids_topk(spark, sf_dir):
    return evaluate.common_ids(_id_sets(_answers(spark, sf_dir)[0]), "ids")


@query(r"""SELECT page_id, array_to_string(list_transform(list_distinct(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?i)track\(', 'cWe-', 'g'), '(?i)CWE[- ]?([0-9]+)', 1)), lambda x: 'CWE-' || x), ',') AS ids FROM pages""")
def extract_ids(spark, sf_dir):
    html = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?i)track\(", "cWe-")
    return st.table(spark, sf_dir, "pages").select("page_id", listed(tx.ids_in(html)).alias("ids"))


@query(
    r"""WITH n AS (SELECT page_id, CAST(nullif(regexp_extract(coalesce(html, ''), '[0-9]+\.?[0-9]*'), '') AS DOUBLE) AS v FROM pages) SELECT page_id, round(CASE WHEN v > 1 THEN v / 100 ELSE v END, 6) AS confidence FROM n"""
)
def extract_confidence(spark, sf_dir):
    return st.table(spark, sf_dir, "pages").select("page_id", r6(tx.confidence(F.col("html"))).alias("confidence"))


@query(
    """WITH a AS (SELECT l_orderkey AS record_id, (['primary', 'secondary', 'tertiary', 'contributing'])[CAST(l_linenumber % 4 AS INTEGER) + 1] AS class, CAST(l_suppkey AS VARCHAR) AS entry_id, min((l_linenumber, l_partkey)) AS spot FROM lineitem GROUP BY 1, 2, 3)
SELECT record_id, coalesce(string_agg(entry_id, ',' ORDER BY spot, entry_id) FILTER (class = 'primary'), '') AS "primary", coalesce(string_agg(entry_id, ',' ORDER BY spot, entry_id) FILTER (class = 'secondary'), '') AS secondary,
coalesce(string_agg(entry_id, ',' ORDER BY spot, entry_id) FILTER (class = 'tertiary'), '') AS tertiary, coalesce(string_agg(entry_id, ',' ORDER BY spot, entry_id) FILTER (class = 'contributing'), '') AS contributing FROM a GROUP BY record_id"""
)
def merge_sources(spark, sf_dir):
    kinds = F.array(*[F.lit(c) for c in evaluate.CLASSES])
    rows = st.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("file"), F.col("l_partkey").alias("pos"), F.get(kinds, (F.col("l_linenumber") % 4).cast("int")).alias("class"), F.col("l_suppkey").cast("string").alias("entry_id"))
    return evaluate.merged_answers(rows).select("record_id", *[listed(c).alias(c) for c in evaluate.CLASSES])


@query("SELECT coalesce(l.doc_id, d.doc_id, e.vec_id) AS record_id, quality, lang, label FROM labels l FULL JOIN documents d ON l.doc_id = d.doc_id FULL JOIN embeddings e ON coalesce(l.doc_id, d.doc_id) = e.vec_id")
def full_outer_consolidate(spark, sf_dir):
    labels, docs, vectors = (st.table(spark, sf_dir, t) for t in ("labels", "documents", "embeddings"))
    return evaluate.three_sources(labels.select(F.col("doc_id").alias("record_id"), "quality"), docs.select(F.col("doc_id").alias("record_id"), "lang"), vectors.select(F.col("vec_id").alias("record_id"), "label"))


@query("SELECT l_orderkey AS entry_id, l_orderkey AS entry_pos, l_returnflag AS kind, l_linenumber AS example_pos FROM lineitem ORDER BY entry_pos, kind, example_pos, entry_id LIMIT 10")
def example_budget(spark, sf_dir):
    rows = st.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.col("l_orderkey").alias("entry_pos"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("example_pos"))
    return evaluate.example_budget(rows)


# -- text building

_PARAGRAPH = "chr(10) || chr(10)"


@query(
    f"""SELECT doc_id, concat_ws({_PARAGRAPH}, 'CWE-' || doc_id || ': ' || source, 'Type: ' || {KIND_SQL.format('doc_id')}, 'Status: ' || lang, CASE WHEN coalesce(text, '') <> '' THEN 'Description:' || {_PARAGRAPH} || text END,
  CASE WHEN doc_id % 3 = 0 THEN 'Extended Details:' || {_PARAGRAPH} || source || ' at length' END,
  CASE WHEN doc_id % 2 = 0 THEN 'Alternative Terms:' || {_PARAGRAPH} || source || ' - ' || lang || chr(10) || 'as ' || source END,
  CASE WHEN doc_id % 5 > 0 THEN 'Real-World Examples:' || {_PARAGRAPH} || '- CVE-' || doc_id || ': ' || lang || {_PARAGRAPH} || '- CVE-1: once' END,
  CASE WHEN doc_id % 7 = 0 THEN 'Top 25 CWE Examples:' || {_PARAGRAPH} || '- CVE-' || doc_id || ': top' END,
  'Related Weaknesses:', '- CWE-' || doc_id % 10 || ' (ChildOf)') AS body FROM documents"""
)
def searchable_text(spark, sf_dir):
    """Documents as entries; every section is there for some and missing for others."""
    docs, i = st.table(spark, sf_dir, "documents"), F.col("doc_id")
    number = i.cast("string")
    pair = lambda a, b, *names: F.struct(*[c.alias(n) for c, n in zip((a, b), names)])
    of = lambda has, *items: F.when(has, F.array(*items)).otherwise(F.slice(F.array(*items), 1, 0))
    seen = lambda a, b: pair(a, b, "Reference", "Description")
    entry = {
        "id": number, "name": F.col("source"), "type": st.kind_of(i), "status": F.col("lang"), "description": F.col("text"),
        "extended": F.when(i % 3 == 0, F.concat("source", F.lit(" at length"))),
        "terms": of(i % 2 == 0, pair(F.col("source"), F.col("lang"), "Term", "Description"), pair(F.concat(F.lit("as "), "source"), F.lit(""), "Term", "Description")),
        "observed": of(i % 5 > 0, seen(F.concat(F.lit("CVE-"), number), F.col("lang")), seen(F.lit("CVE-1"), F.lit("once"))),
        "top": of(i % 7 == 0, seen(F.concat(F.lit("CVE-"), number), F.lit("top"))),
        "related": F.array(pair((i % 10).cast("string"), F.lit("ChildOf"), "CweID", "Nature")),
    }
    return docs.select("doc_id", tx.searchable_text(entry).alias("body"))


_QUERY_TEXT = f"'weakness: ' || array_to_string({_WORDS}[1:2], ' ') || ', rootcause: ' || array_to_string({_WORDS}[3:4], ' ') || chr(10) || text"


def _query_text() -> Column:
    words = F.array_remove(F.split("text", r"\s+"), "")
    part = lambda a: F.array_join(F.slice(words, a, 2), " ")
    return F.concat(F.lit("weakness: "), part(1), F.lit(", rootcause: "), part(3), F.lit("\n"), F.col("text"))


@query(
    rf"""WITH q AS (SELECT item_id, {_QUERY_TEXT} AS q FROM benchmark) SELECT item_id, nullif(trim(regexp_extract(q, '(?i)rootcause:\s*([^,\n]+)', 1)), '') AS rootcause, nullif(trim(regexp_extract(q, '(?i)weakness:\s*([^,\n]+)', 1)), '') AS weakness FROM q"""
)
def keyphrase_extract(spark, sf_dir):
    rows = st.table(spark, sf_dir, "benchmark").select("item_id", _query_text().alias("q"))
    return rows.select("item_id", tx.phrase_in(F.col("q"), "rootcause").alias("rootcause"), tx.phrase_in(F.col("q"), "weakness").alias("weakness"))


@query(f"SELECT item_id, replace(text, {_WORDS}[2], '**' || {_WORDS}[2] || '**') AS body FROM benchmark WHERE len({_WORDS}) > 1")
def highlight(spark, sf_dir):
    words = F.array_remove(F.split("text", r"\s+"), "")
    return st.table(spark, sf_dir, "benchmark").where(F.size(words) > 1).select("item_id", tx.highlighted(F.col("text"), F.get(words, F.lit(1))).alias("body"))


@query(
    """SELECT CAST(l_orderkey AS VARCHAR) AS "CVE_ID", string_agg(CAST(l_suppkey AS VARCHAR), '|' ORDER BY l_linenumber, l_suppkey) AS "Detected_CWEs", format('{:,.2f}', count(*)::DOUBLE) AS "Processing_Time" FROM lineitem GROUP BY l_orderkey
UNION ALL SELECT 'none-' || n_nationkey, 'ERROR', '0.00' FROM nation"""
)
def csv_summary_join(spark, sf_dir):
    rows = st.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("l"))
    results = rows.select(F.col("l_orderkey").cast("string").alias("record_id"), F.transform("l", lambda x: x["l_suppkey"].cast("string")).alias("ids"), F.size("l").cast("double").alias("seconds"))
    return sinks.run_summary(results, st.table(spark, sf_dir, "nation").select(F.concat(F.lit("none-"), "n_nationkey").alias("record_id")))


@query("SELECT c_custkey, c_name, CASE WHEN length(c_name) > 12 THEN substring(c_name, 1, 9) || '...' ELSE c_name END AS short_name, '' || c_custkey // 1000 || 'xxx' AS shard FROM customer")
def names_and_shards(spark, sf_dir):
    return st.table(spark, sf_dir, "customer").select("c_custkey", "c_name", tx.shortened(F.col("c_name"), 12, 9).alias("short_name"), tx.shard(F.col("c_custkey")).alias("shard"))


# -- windows over events

_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def _time(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _event_rows(spark, sf_dir) -> DataFrame:
    return st.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, event_id, age FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS age FROM events) WHERE age <= 5")
def context_last_n(spark, sf_dir):
    return ev.last_n(_event_rows(spark, sf_dir), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "age")


@query(f"SELECT {_TIME.format('w')} AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type, value FROM events) GROUP BY w, event_type")
def event_tumbling(spark, sf_dir):
    return ev.tumbling(_event_rows(spark, sf_dir)).select(_time("start"), "event_type", "n", r6("total").alias("total"))


@query(f"SELECT {_TIME.format('w')} AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS w, event_type, value FROM events, range(2) r(k)) GROUP BY w, event_type")
def event_sliding(spark, sf_dir):
    return ev.sliding(_event_rows(spark, sf_dir)).select(_time("start"), "event_type", "n", r6("total").alias("total"))


@query(
    f"""WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM b)
SELECT user_id, {_TIME.format('min(ts)')} AS start, {_TIME.format("max(ts) + INTERVAL 30 MINUTE")} AS "end", count(*) AS n FROM s GROUP BY user_id, s"""
)
def event_session(spark, sf_dir):
    return ev.sessions(_event_rows(spark, sf_dir)).select("user_id", _time("start"), _time("end"), "n")


@query("SELECT user_id, event_type, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS pct FROM events GROUP BY user_id, event_type")
def percent_of_total(spark, sf_dir):
    rows = _event_rows(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return rows.withColumn("pct", r6(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))))


# -- retrieval over the graph, and reports

@query(
    f"""WITH {ALL_EDGES_SQL}, n AS (SELECT DISTINCT src AS node, 0 AS way, rel_type, dst AS other FROM edges UNION SELECT dst, 1, rel_type, src FROM edges)
SELECT node, string_agg(CASE way WHEN 0 THEN '-> ' ELSE '<- ' END || rel_type || ' ' || other, chr(10) ORDER BY way, rel_type, other) AS neighbours FROM n GROUP BY node"""
)
def node_neighbourhood(spark, sf_dir):
    return reports.node_neighbours(st.all_edges(spark, sf_dir))


@query(
    f"""WITH {GRAPH_SQL}, r AS (SELECT src AS node, rel_type, dst AS other, row_number() OVER (PARTITION BY src ORDER BY rel_type, dst) AS n FROM hierarchy)
SELECT node, string_agg('- ' || rel_type || ': ' || other || ' (' || coalesce(name, 'unknown') || ')', chr(10) ORDER BY n) AS relations FROM r LEFT JOIN nodes ON id = other WHERE n <= 5 GROUP BY node"""
)
def relationship_text(spark, sf_dir):
    return reports.relationship_text(st.hierarchy(spark, sf_dir), st.nodes(spark, sf_dir))


@query(
    f"""WITH {HITS_SQL}, best AS (SELECT query_id, entry_id, retriever, round(max(score), 6) AS score FROM hits GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, retriever ORDER BY score DESC, entry_id) AS n FROM best WHERE retriever IN ('dense', 'sparse'))
SELECT DISTINCT query_id, entry_id FROM r WHERE n <= 2"""
)
def seed_injection(spark, sf_dir):
    return retrieval.seeds_of_hits(st.hits(spark, sf_dir), 2)


@query(
    f"""WITH {HITS_SQL}, d AS (SELECT DISTINCT query_id, retriever, entry_id FROM hits), a AS (SELECT *, count(*) OVER (PARTITION BY query_id, entry_id) = 1 AS alone FROM d)
SELECT query_id, retriever, count(*) AS found, count(*) FILTER (alone) AS "unique" FROM a GROUP BY query_id, retriever"""
)
def retriever_comparison(spark, sf_dir):
    return reports.retriever_comparison(st.hits(spark, sf_dir))


@query(
    f"""WITH {_FUSED}, f AS (
  SELECT w.*, abstraction, n_relations, CASE WHEN s >= d AND s >= g THEN 'sparse' WHEN g >= d THEN 'graph' ELSE 'dense' END AS top FROM wide w JOIN entries USING (entry_id)
), tops AS (SELECT query_id, top FROM f GROUP BY query_id, top QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, top) = 1),
n AS (SELECT query_id, count(*) AS n_entries, count(*) FILTER (found_by LIKE '%+%') AS n_several, count(*) FILTER (found_by = 'graph' AND n_relations > 0) AS n_bonus, count(*) FILTER (abstraction IN ('Base', 'Variant')) AS n_specific FROM f GROUP BY query_id)
SELECT n.*, top AS top_retriever FROM n JOIN tops USING (query_id)"""
)
def interpretation(spark, sf_dir):
    return reports.interpretation(fusion.fuse(st.hits(spark, sf_dir), F.broadcast(st.entries(spark, sf_dir))))


@query(
    f"""WITH {_FUSED}, r AS (SELECT *, {_RANK} FROM fused)
SELECT query_id, '| rank | id | name | score |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg('| ' || rank || ' | ' || entry_id || ' | entry ' || entry_id || ' | ' || format('{{:.4f}}', score) || ' |', chr(10) ORDER BY rank) AS "table" FROM r WHERE rank <= 3 GROUP BY query_id"""
)
def results_table(spark, sf_dir):
    rows = fusion.fuse(st.hits(spark, sf_dir), F.broadcast(st.entries(spark, sf_dir)), 3)
    return reports.result_table(rows.withColumn("name", F.concat(F.lit("entry "), "entry_id")))


def _nation_queries(spark, sf_dir) -> DataFrame:
    return st.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_name").alias("text"))


@query(
    f"""WITH {GRAPH_SQL}, {_bm25_sql('SELECT CAST(n_nationkey AS BIGINT) AS query_id, n_name AS text FROM nation').replace('FROM documents', 'FROM (SELECT id AS doc_id, name AS text FROM nodes)')},
best AS (SELECT query_id, max(score) AS best FROM scores GROUP BY query_id),
shares AS (SELECT query_id, doc_id AS node, round(least(score / best, 1.0), 6) AS score FROM scores JOIN best USING (query_id) WHERE score > 0 AND score / best > 0.3)
SELECT query_id, node, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS INTEGER) AS rank FROM shares QUALIFY rank <= 20"""
)
def keyword_match(spark, sf_dir):
    return retrieval.keyword_matches(st.nodes(spark, sf_dir), _nation_queries(spark, sf_dir)).select("query_id", "node", "score", "rank")


@query("SELECT 'sparse' AS retriever, count(*) AS n FROM documents UNION ALL SELECT 'dense', count(*) FROM embeddings UNION ALL SELECT 'graph_nodes', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) UNION ALL " + f"(WITH {GRAPH_SQL} SELECT 'graph_edges', count(*) FROM hierarchy)")
def retriever_metadata(spark, sf_dir):
    return retrieval.metadata(st.table(spark, sf_dir, "documents"), st.table(spark, sf_dir, "embeddings"), st.nodes(spark, sf_dir), st.hierarchy(spark, sf_dir))


def _walk_sql(name: str, seeds: str, moves: str, depth: int) -> str:
    """CTEs up to ``name`` (seed, node, level, weight): least levels from seeds (seed, node) over moves (src, dst, w)."""
    return f"""{name}_moves AS (SELECT src, dst, max(w) AS w FROM ({moves}) GROUP BY src, dst),
{name}_walk AS (SELECT seed, node, 0 AS level FROM {seeds} UNION SELECT seed, dst, level + 1 FROM {name}_walk JOIN {name}_moves ON src = node WHERE level < {depth}),
{name}_levels AS (SELECT seed, node, min(level) AS level FROM {name}_walk GROUP BY seed, node),
{name} AS (
  SELECT l.seed, l.node, l.level, max(m.w) AS weight FROM {name}_levels l JOIN {name}_moves m ON m.dst = l.node JOIN {name}_levels p ON p.seed = l.seed AND p.node = m.src AND p.level = l.level - 1
  GROUP BY l.seed, l.node, l.level
)"""


_EDGE_WEIGHT = "CASE rel_type WHEN 'CHILDOF' THEN 0.3::DOUBLE WHEN 'PEEROF' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END"
_ABSTRACTION = "CASE {} WHEN 'Base' THEN 1.3::DOUBLE WHEN 'Variant' THEN 1.2::DOUBLE WHEN 'Class' THEN 0.8::DOUBLE WHEN 'Pillar' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END"
_ONE_WAY = "SELECT src, dst, 1.0::DOUBLE AS w FROM edges WHERE rel_type = 'CANPRECEDE'"

_HYBRID_SQL = f"""WITH RECURSIVE {ALL_EDGES_SQL},
{_bm25_sql("SELECT n_nationkey || '|base' AS query_id, n_name AS text FROM nation UNION ALL SELECT n_nationkey || '|weakness', n_name || ' ' || n_name FROM nation", 12).replace('FROM documents', 'FROM (SELECT id AS doc_id, name AS text FROM nodes)')},
named_scores AS (SELECT split_part(query_id, '|', 1)::BIGINT AS query_id, split_part(query_id, '|', 2) AS source, doc_id AS node, score FROM scores),
first_sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY round(score, 6) DESC, node) AS n FROM named_scores),
boosted AS (
  SELECT query_id, node, round(max(round(score, 6)) * (1 + CASE WHEN bool_or(source = 'weakness') THEN 1.8::DOUBLE ELSE 0 END), 6) AS score
  FROM first_sparse WHERE n <= CASE source WHEN 'base' THEN 40 ELSE 20 END GROUP BY query_id, node
), sparse_hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS n FROM boosted) WHERE n <= 10),
cosines AS (
  SELECT q.n_nationkey::BIGINT AS query_id, 'C' || v.vec_id AS node, list_cosine_similarity(v.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS score
  FROM nation q JOIN embeddings a ON a.vec_id = q.n_nationkey CROSS JOIN embeddings v
), dense_hits AS (
  SELECT query_id, node, score, n FROM (SELECT query_id, node, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, node) AS n FROM cosines WHERE score >= 0.3) WHERE n <= 10
), best AS (SELECT query_id, max(score) AS best FROM named_scores WHERE source = 'base' GROUP BY query_id),
shares AS (SELECT query_id, node, round(least(score / best, 1.0), 6) AS score, score / best AS share FROM named_scores JOIN best USING (query_id) WHERE source = 'base' AND score > 0),
places AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS n FROM shares),
own AS (
  SELECT query_id AS seed, node FROM places WHERE share > 0.5 AND n <= 5 UNION SELECT query_id, node FROM dense_hits WHERE n <= 5 UNION SELECT query_id, node FROM sparse_hits WHERE n <= 5
), typed AS (SELECT seed, node, type FROM own JOIN nodes ON id = node),
parents AS (SELECT src, min(dst) AS dst FROM hierarchy GROUP BY src),
up AS (SELECT seed, node AS spot, 0 AS level FROM typed WHERE type IN ('Variant', 'Base') UNION ALL SELECT seed, dst, level + 1 FROM up JOIN parents ON src = spot WHERE level < 3),
tops AS (SELECT seed, node AS top, node, 0 AS level FROM typed WHERE type IN ('Class', 'Pillar', 'Base') UNION SELECT seed, top, src, level + 1 FROM tops JOIN hierarchy ON dst = node WHERE level < 2),
{_walk_sql('chain', 'own', f"SELECT src, dst, {_EDGE_WEIGHT} AS w FROM edges UNION ALL SELECT dst, src, {_EDGE_WEIGHT} FROM edges", 3)},
{_walk_sql('forward', 'own', _ONE_WAY, 3)},
{_walk_sql('backward', 'own', _ONE_WAY.replace('src, dst', 'dst AS src, src AS dst'), 3)},
{_walk_sql('peer', 'own', "SELECT src, dst, 1.0::DOUBLE AS w FROM likes UNION ALL SELECT dst, src, 1.0::DOUBLE FROM likes", 2)},
{_ENDS},
rich AS (SELECT id, least(0.3::DOUBLE, 0.1::DOUBLE * count(DISTINCT rel_type) + 0.005::DOUBLE * count(*)) AS score FROM ends GROUP BY id),
strategies AS (
  SELECT seed AS query_id, node, 'explicit_mention' AS strategy, 1.0::DOUBLE AS part FROM own
  UNION ALL SELECT seed, node, 'relationship_chain', 0.9::DOUBLE * weight * greatest(0.5::DOUBLE, 1 - 0.2::DOUBLE * (level - 1)) FROM chain
  UNION ALL SELECT seed, node, 'sequence_path', 0.8::DOUBLE * pow(0.8::DOUBLE, level - 1) FROM forward
  UNION ALL SELECT seed, node, 'sequence_path', 0.8::DOUBLE * pow(0.8::DOUBLE, level - 1) FROM backward
  UNION ALL SELECT seed, node, 'peer_group', 0.6::DOUBLE * 0.9::DOUBLE * pow(0.7::DOUBLE, level - 1) FROM peer
  UNION ALL SELECT seed, node, 'vulnerability_chain', 0.9::DOUBLE * (0.9::DOUBLE - 0.1::DOUBLE * (level - 1)) FROM forward
  UNION ALL SELECT seed, spot, 'abstraction_path', 0.7::DOUBLE * 0.8::DOUBLE * pow(0.7::DOUBLE, level) FROM up WHERE level > 0
  UNION ALL SELECT seed, node, 'abstraction_path', 0.7::DOUBLE * CASE type WHEN 'Base' THEN 0.9::DOUBLE WHEN 'Variant' THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END * pow(0.8::DOUBLE, level)
    FROM (SELECT seed, top, node, min(level) AS level FROM tops GROUP BY seed, top, node) JOIN nodes ON id = node
  UNION ALL SELECT seed, node, 'relationship_richness', 0.5::DOUBLE * score FROM own JOIN rich ON id = node
  UNION ALL SELECT query_id, node, 'keyword_match', 0.8::DOUBLE * score FROM places WHERE share > 0.3 AND n <= 20
  UNION ALL SELECT query_id, node, 'chain_starting_point', 0.85::DOUBLE * 0.8::DOUBLE * score FROM places WHERE share > 0.4 AND n <= 5
), total AS (
  SELECT query_id, node, sum(part) AS score FROM (SELECT query_id, node, strategy, max(part) AS part FROM strategies GROUP BY ALL) GROUP BY query_id, node HAVING sum(part) >= 0.05
), graph_hits AS (
  SELECT * FROM (
    SELECT query_id, node, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS n FROM (SELECT query_id, node, round(score * {_ABSTRACTION.format('type')}, 6) AS score FROM total JOIN nodes ON id = node)
  ) WHERE n <= 10
), hits AS (
  SELECT query_id, node AS entry_id, 'sparse' AS retriever, score FROM sparse_hits UNION ALL SELECT query_id, node, 'dense', score FROM dense_hits UNION ALL SELECT query_id, node, 'graph', score FROM graph_hits
), wide AS (
  SELECT query_id, entry_id, sum({_NORM} * {_WEIGHT}) AS weighted, string_agg(retriever, '+' ORDER BY retriever) AS found_by FROM hits GROUP BY query_id, entry_id
), degree AS (SELECT id, count(*) AS n_relations FROM ends GROUP BY id),
fused AS (
  SELECT query_id, entry_id, round(weighted * {_ABSTRACTION.format('type')}
    * CASE WHEN found_by = 'graph' AND n_relations > 0 THEN 1 + least(0.15::DOUBLE * n_relations, 0.45::DOUBLE) ELSE 1.0::DOUBLE END
    * CASE {USAGE_SQL.format('length(name)')} WHEN 'Allowed' THEN 1.1::DOUBLE WHEN 'Allowed-with-Review' THEN 1.05::DOUBLE WHEN 'Discouraged' THEN 0.8::DOUBLE WHEN 'Prohibited' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score
  FROM wide LEFT JOIN nodes ON nodes.id = entry_id LEFT JOIN degree ON degree.id = entry_id
)
SELECT query_id, entry_id, score, {_RANK} FROM fused QUALIFY rank <= 10"""


@query(_HYBRID_SQL)
def hybrid_search(spark, sf_dir):
    """Nation names against the nodes: text, vectors and all graph strategies, fused."""
    nodes, edges = st.nodes(spark, sf_dir), st.all_edges(spark, sf_dir)
    asked = _nation_queries(spark, sf_dir).withColumn("phrases", F.create_map(F.lit("weakness"), F.array("text")))
    vectors = st.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    near = asked.select("query_id").join(vectors.withColumnRenamed("vec_id", "query_id"), "query_id").select("query_id", F.col("embedding").alias("query"))
    hits = retrieval.search(asked, retrieval.node_text(nodes), vectors.withColumn("vec_id", F.concat(F.lit("C"), "vec_id")), near, nodes, edges, 5)
    degree = graph.degrees(edges).select(F.col("id").alias("entry_id"), F.col("degree").alias("n_relations"))
    entries = nodes.select(F.col("id").alias("entry_id"), F.col("type").alias("abstraction"), st.usage_of(F.length("name")).alias("usage")).join(degree, "entry_id", "left").fillna(0, ["n_relations"])
    return fusion.fuse(hits, entries, 10).select("query_id", "entry_id", "score", "rank")


from weavegrid.plans import formats, remembered  # noqa: E402, F401  (register their queries)

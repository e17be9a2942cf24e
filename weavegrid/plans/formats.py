"""Further queries of the catalogue: fallbacks, ids and records, formats, reports and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weavegrid.functions import text as tx
from weavegrid.functions.config import GRAPH
from weavegrid.operators import consensus, evaluate, fusion, graph, reports, retrieval, sparse, usage
from weavegrid.plans import standins as st
from weavegrid.plans.catalogue import _ANSWERS as ANSWERS
from weavegrid.plans.catalogue import _COMPARED, _FUSED, _NORM, _RANK, _TOKENS, _WORDS, _bm25_sql, _compared, _nation_queries, listed, query, r6
from weavegrid.plans.standins import ENTRIES_SQL, GRAPH_SQL, HITS_SQL, USAGE_LOG_SQL
from weavegrid.sources import sinks

_NODE_SCORES = f"{GRAPH_SQL}, {_bm25_sql('SELECT CAST(n_nationkey AS BIGINT) AS query_id, n_name AS text FROM nation').replace('FROM documents', 'FROM (SELECT id AS doc_id, name AS text FROM nodes)')}"

# -- retrieval beyond matches

@query(
    f"""WITH {_NODE_SCORES}, filled AS (
  SELECT query_id, doc_id, score FROM scores
  UNION ALL SELECT a.query_id, d.id, 0.0::DOUBLE FROM asked a, (SELECT id FROM nodes ORDER BY id LIMIT 5) d WHERE NOT EXISTS (SELECT 1 FROM scores s WHERE s.query_id = a.query_id AND s.doc_id = d.id)
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM filled)
SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 5"""
)
def bm25_zero_fill(spark, sf_dir):
    """Names that one node has: the other four places go to nodes with score 0."""
    docs = retrieval.node_text(st.nodes(spark, sf_dir))
    return sparse.bm25_topk(docs, _nation_queries(spark, sf_dir), 5).select("query_id", "doc_id", "score", "rank")


@query(
    f"""WITH {GRAPH_SQL}, found AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, id AS node FROM nation JOIN nodes ON contains(lower(name), lower(n_name)))
SELECT query_id, node, 1.0::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY node) AS INTEGER) AS rank FROM found QUALIFY rank <= 10"""
)
def substring_short_queries(spark, sf_dir):
    return retrieval.substring_fallback(_nation_queries(spark, sf_dir), st.nodes(spark, sf_dir), 5).select("query_id", "node", "score", "rank")


@query(
    f"""WITH {_NODE_SCORES}, best AS (SELECT query_id, max(score) AS best FROM scores GROUP BY query_id),
shares AS (SELECT query_id, doc_id AS node, round(least(score / best, 1.0), 6) AS score FROM scores JOIN best USING (query_id) WHERE score > 0 AND score / best > 0.4),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS n FROM shares)
SELECT query_id, node, round(0.8::DOUBLE * score, 6) AS score FROM r WHERE n <= 5"""
)
def chain_start_points(spark, sf_dir):
    asked = _nation_queries(spark, sf_dir).withColumn("phrases", F.create_map(F.lit("rootcause"), F.array("text")))
    return retrieval.chain_seeds(asked, st.nodes(spark, sf_dir)).withColumn("score", r6("score"))


@query(
    f"""WITH {_NODE_SCORES}, best AS (SELECT query_id, max(score) AS best FROM scores GROUP BY query_id),
shares AS (SELECT query_id, doc_id AS node, round(least(score / best, 1.0), 6) AS score FROM scores JOIN best USING (query_id) WHERE score > 0 AND score / best > 0.5)
SELECT query_id, node FROM shares QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) <= 5"""
)
def traversal_starts(spark, sf_dir):
    asked = _nation_queries(spark, sf_dir).withColumn("phrases", F.create_map(F.lit("weakness"), F.array("text")))
    return retrieval.starting_nodes(asked, st.nodes(spark, sf_dir))


@query(
    f"""WITH {HITS_SQL}, best AS (SELECT query_id, entry_id, max(score) AS top FROM hits GROUP BY ALL)
SELECT query_id, entry_id, round(2 * top, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(2 * top, 6) DESC, entry_id) AS INTEGER) AS rank FROM best QUALIFY rank <= 3"""
)
def rerank_by_model(spark, sf_dir):
    hits = st.hits(spark, sf_dir).groupBy("query_id", "entry_id").agg(F.max("score").alias("score"))
    return fusion.rerank(hits, 3, model=lambda h: h["score"] * 2).select("query_id", "entry_id", "score", "rank")


@query(
    f"""WITH {HITS_SQL}, r AS (SELECT query_id, retriever, entry_id, round({_NORM}, 6) AS norm, row_number() OVER (PARTITION BY query_id, retriever ORDER BY round(score, 6) DESC, entry_id) AS n FROM (SELECT query_id, retriever, entry_id, max(score) AS score FROM hits GROUP BY ALL))
SELECT query_id, retriever, entry_id, norm, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 2"""
)
def retrievers_by_themselves(spark, sf_dir):
    hits = fusion.best_hits(st.hits(spark, sf_dir))
    return retrieval.top_normalized(hits, 2).select("query_id", "retriever", "entry_id", r6("norm").alias("norm"), "rank")


@query(
    f"""WITH {ENTRIES_SQL}, {HITS_SQL}, known AS (SELECT entry_id, abstraction, usage, 'as ' || usage AS comments, CASE WHEN entry_id % 2 = 0 THEN 'reason ' || entry_id END AS reason FROM entries WHERE entry_id < 5)
SELECT query_id, h.entry_id, count(*) AS n, coalesce(abstraction, 'Unknown') AS abstraction, coalesce(usage, 'Not specified') AS usage, coalesce(comments, '') AS comments, coalesce(reason, '') AS reasons,
  CASE WHEN h.entry_id < 5 THEN 'see ' || (h.entry_id + 1) || ',or ' || (h.entry_id + 2) ELSE '' END AS suggestions
FROM hits h LEFT JOIN known USING (entry_id) GROUP BY ALL"""
)
def mapping_defaults(spark, sf_dir):
    """Entries with one reason as text, some without, and two suggestions as a list; two entries are unknown."""
    e = F.col("entry_id")
    known = st.entries(spark, sf_dir).where("entry_id < 5").select("entry_id", "abstraction", "usage", F.concat(F.lit("as "), "usage").alias("comments"), F.when(e % 2 == 0, F.concat(F.lit("reason "), e)).alias("reasons"), F.array(F.concat(F.lit("see "), e + 1), F.concat(F.lit("or "), e + 2)).alias("suggestions"))
    rows = fusion.with_mapping(st.hits(spark, sf_dir), known).withColumns({"reasons": listed("reasons"), "suggestions": listed("suggestions")})
    return rows.groupBy("query_id", "entry_id", "abstraction", "usage", "comments", "reasons", "suggestions").agg(F.count("*").alias("n"))


@query(
    f"""WITH {ENTRIES_SQL}, {HITS_SQL}, typed AS (SELECT *, CASE WHEN retriever <> 'sparse' AND query_id % 3 > 0 THEN retriever || ' type' WHEN retriever = 'sparse' THEN 'never' END AS type FROM hits),
found AS (SELECT query_id, entry_id, count(DISTINCT retriever) AS n, min(type) FILTER (retriever = 'dense') AS d, min(type) FILTER (retriever = 'graph') AS g FROM typed GROUP BY ALL)
SELECT query_id, entry_id, coalesce(CASE WHEN entry_id < 4 THEN abstraction END, CASE WHEN n > 1 THEN coalesce(d, g) END, 'Unknown') AS abstraction FROM found JOIN entries USING (entry_id)"""
)
def abstraction_fixed(spark, sf_dir):
    kind = F.when((F.col("retriever") != "sparse") & (F.col("query_id") % 3 > 0), F.concat("retriever", F.lit(" type"))).when(F.col("retriever") == "sparse", "never")
    return fusion.abstraction_fixed(st.hits(spark, sf_dir).withColumn("type", kind), st.entries(spark, sf_dir).where("entry_id < 4"))


@query(
    f"""WITH {ENTRIES_SQL}, {HITS_SQL}, best AS (SELECT query_id, entry_id, retriever, max(score) AS score FROM hits GROUP BY ALL),
shown AS (
  SELECT *, '{{"cwe_id":"' || entry_id || '","name":"' || CASE WHEN entry_id < 6 THEN 'entry ' || entry_id ELSE 'Unknown' END || '","abstraction":"' || CASE WHEN entry_id < 6 THEN abstraction ELSE 'unknown' END
    || '","score":"' || format('{{:,.4f}}', score) || '","description":"' || CASE WHEN entry_id < 6 AND entry_id % 2 = 1 THEN repeat('d', least(200, 50 * entry_id)) || '...' ELSE '' END
    || '","mapping_usage":"' || CASE WHEN entry_id < 6 THEN usage ELSE 'Not specified' END || '"}}' AS j FROM best JOIN entries USING (entry_id)
)
SELECT query_id, retriever, '{{"count":' || count(*) || ',"results":[' || string_agg(j, ',' ORDER BY score DESC, entry_id) || '],"statistics":{{"min":"' || format('{{:,.6f}}', min(score)) || '","max":"' || format('{{:,.6f}}', max(score)) || '","mean":"' || format('{{:,.6f}}', avg(score)) || '"}}}}' AS json
FROM shown GROUP BY query_id, retriever"""
)
def raw_retriever_reports(spark, sf_dir):
    """What each retriever found for each order; one of seven entries is unknown, and every second has a long description."""
    e = F.col("entry_id")
    known = st.entries(spark, sf_dir).where("entry_id < 6").select("entry_id", F.concat(F.lit("entry "), e).alias("name"), "abstraction", "usage", F.when(e % 2 == 1, F.repeat(F.lit("d"), (50 * e).cast("int"))).alias("description"))
    return fusion.raw_results(st.hits(spark, sf_dir), F.broadcast(known))


@query(
    f"""WITH {GRAPH_SQL}, members AS (
  SELECT id AS seed, id, name, 'primary' AS class FROM nodes WHERE type = 'Class' UNION SELECT src, dst, b.name, 'secondary' FROM hierarchy JOIN nodes b ON b.id = dst WHERE src LIKE 'N%'
  UNION SELECT dst, src, b.name, 'secondary' FROM hierarchy JOIN nodes b ON b.id = src WHERE dst LIKE 'N%'
), lines AS (
  SELECT seed, 0 AS part, '    ' || id || '["' || CASE WHEN length(name) > 25 THEN name[1:22] || '...' ELSE name END || '"]' AS line FROM members
  UNION SELECT src, 1, '    ' || src || ' -->|childof| ' || dst FROM hierarchy WHERE src LIKE 'N%' UNION SELECT dst, 1, '    ' || src || ' -->|childof| ' || dst FROM hierarchy WHERE dst LIKE 'N%'
  UNION SELECT seed, 2, '    class ' || id || ' ' || class FROM members
)
SELECT seed, 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY part, line) || chr(10) || '    classDef primary fill:#f96,stroke:#333,stroke-width:2px' || chr(10) || '    classDef secondary fill:#69f,stroke:#333' || chr(10) || '    classDef tertiary fill:#9e9,stroke:#333' AS diagram
FROM lines GROUP BY seed"""
)
def mermaid_classes(spark, sf_dir):
    """Nations as primary nodes with the nodes next to them as secondary ones."""
    nodes, edges = st.nodes(spark, sf_dir), st.hierarchy(spark, sf_dir)
    seeds = nodes.where("type = 'Class'").select(F.col("id").alias("seed"), F.col("id").alias("node"))
    found, inside = graph.neighbourhood(edges, seeds, depth=1)
    members = found.join(nodes.withColumnRenamed("id", "node"), "node").select("seed", F.col("node").alias("id"), "name", F.when(F.col("level") == 0, "primary").otherwise("secondary").alias("class"))
    return graph.mermaid(members, inside)


_SHOWN = "CASE retriever WHEN 'dense' THEN 0 WHEN 'sparse' THEN 1 ELSE 2 END"
_ENTRY_NAMES = "CASE WHEN entry_id < 6 THEN 'entry ' || entry_id ELSE 'Unknown' END"


@query(
    f"""WITH {_FUSED}, norms AS (
  SELECT query_id, entry_id, string_agg(retriever, ', ' ORDER BY {_SHOWN}) AS retrievers, string_agg(retriever || '=' || format('{{:.3f}}', norm), ', ' ORDER BY {_SHOWN}) AS found_by FROM normed GROUP BY ALL
), r AS (SELECT *, {_RANK} FROM fused)
SELECT r.query_id, rank, r.entry_id, {_ENTRY_NAMES.replace('entry_id', 'r.entry_id')} AS name, CASE WHEN r.entry_id < 6 THEN abstraction ELSE 'Unknown' END AS abstraction, CASE WHEN r.entry_id < 6 THEN usage ELSE 'Not specified' END AS usage,
  format('{{:,.4f}}', score) AS score, retrievers, n.found_by
FROM r JOIN entries e ON e.entry_id = r.entry_id JOIN norms n ON n.query_id = r.query_id AND n.entry_id = r.entry_id WHERE rank <= 3"""
)
def results_rows(spark, sf_dir):
    entries = st.entries(spark, sf_dir)
    known = entries.where("entry_id < 6").withColumn("name", F.concat(F.lit("entry "), "entry_id"))
    return fusion.result_rows(fusion.fuse(st.hits(spark, sf_dir), F.broadcast(entries), 3), known)


@query(
    f"""WITH {_FUSED}, r AS (SELECT *, {_RANK} FROM fused) SELECT query_id, rank, '{{"id":"' || entry_id || '","name":"' || {_ENTRY_NAMES} || '","abstraction":"Unknown","usage":"Not specified","score":"' || format('{{:,.4f}}', score) || '"}}' AS json FROM r WHERE rank <= 2"""
)
def sparse_format(spark, sf_dir):
    entries = st.entries(spark, sf_dir)
    known = entries.where("entry_id < 6").select("entry_id", F.concat(F.lit("entry "), "entry_id").alias("name"), F.lit(None).cast("string").alias("abstraction"), F.lit(None).cast("string").alias("usage"))
    hits = fusion.fuse(st.hits(spark, sf_dir), F.broadcast(entries), 2).select("query_id", "rank", "entry_id", "score")
    return fusion.formatted_sparse(hits, known)


# -- ids and records

@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 5 < 4 THEN 'CWE-' || s_suppkey END AS entry_id FROM supplier"""
)
def canonical_ids(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    raw = F.get(F.array(k, F.concat(F.lit("CWE-"), k), F.concat(F.lit(" cwe "), k), F.concat(F.lit("Cwe"), k), F.concat(F.lit("no "), k)), (F.col("s_suppkey") % 5).cast("int"))
    return st.table(spark, sf_dir, "supplier").select("s_suppkey", tx.canonical_id(raw).alias("entry_id"))


@query(
    r"""SELECT page_id, array_to_string(list_transform(list_distinct(regexp_extract_all(replace(coalesce(html, ''), 'track(', 'cwe '), '(?i)CWE[- ]?([0-9]+)', 1)), lambda x: 'CWE-' || x), ',') AS ids FROM pages"""
)
def ids_in_pages(spark, sf_dir):
    html = F.replace(F.coalesce("html", F.lit("")), F.lit("track("), F.lit("cwe "))
    return st.table(spark, sf_dir, "pages").select("page_id", listed(tx.ids_in(html)).alias("ids"))


@query(
    """SELECT o_orderkey, (1999 + o_orderkey % 25) || '/' || o_orderkey // 1000 || 'xxx/CVE-' || (1999 + o_orderkey % 25) || '-' || o_orderkey AS path, 'CVE-' || (1999 + o_orderkey % 25) || '-' || o_orderkey AS record_id FROM orders"""
)
def record_paths(spark, sf_dir):
    record = F.concat(F.lit("CVE-"), (1999 + F.col("o_orderkey") % 25).cast("string"), F.lit("-"), F.col("o_orderkey").cast("string"))
    rows = st.table(spark, sf_dir, "orders").select("o_orderkey", tx.record_path(record).alias("path"))
    return rows.withColumn("record_id", tx.record_id_in(F.concat("path", F.lit("/answer.md"))))


@query("SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' WHEN length(text) > 3000 THEN 'too long' END AS reason FROM documents")
def input_validity(spark, sf_dir):
    return st.table(spark, sf_dir, "documents").select("doc_id", tx.validity(F.col("text"), 3000).alias("reason"))


@query(f"SELECT item_id, {_WORDS}[1] || ' ' || {_WORDS}[2] || ' and ' || {_WORDS}[3] AS phrase, 'rootcause' AS kinds, '- rootcause: ' || {_WORDS}[1] || ' ' || {_WORDS}[2] || ',  , ' || {_WORDS}[3] || chr(10) || '- vector: ' || {_WORDS}[4] AS bullets FROM benchmark")
def phrase_texts(spark, sf_dir):
    words = F.array_remove(F.split("text", r"\s+"), "")
    w = lambda i: F.get(words, F.lit(i))
    rows = st.table(spark, sf_dir, "benchmark").select("item_id", F.create_map(F.lit("rootcause"), F.array(F.concat_ws(" ", w(0), w(1)), F.lit(" "), w(2)), F.lit("vector"), F.array(w(3))).alias("phrases"))
    return rows.select("item_id", tx.joined_phrase(F.col("phrases")["rootcause"]).alias("phrase"), listed(F.map_keys(tx.search_phrases(F.col("phrases")))).alias("kinds"), reports.phrase_list(F.col("phrases")).alias("bullets"))


@query(r"SELECT item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM benchmark")
def fences_taken_off(spark, sf_dir):
    return st.table(spark, sf_dir, "benchmark").select("item_id", tx.without_fences(F.concat(F.lit("\n```json\n"), "text", F.lit("\n```\n"))).alias("body"))


@query(
    """SELECT p_partkey, '{"id":"' || p_partkey || '","name":"' || p_name || '","type":"' || p_brand || '","description":"' || p_type || '","AlternateTerms":[],"RelatedWeaknesses":[{"Nature":"ChildOf","CweID":"' || p_size || '"}]}' AS document FROM part"""
)
def embedding_documents(spark, sf_dir):
    one = F.struct(F.lit("ChildOf").alias("Nature"), F.col("p_size").cast("string").alias("CweID"), F.lit(None).cast("string").alias("ViewID"), F.lit(None).cast("string").alias("Ordinal"))
    terms = F.lit(None).cast("array<struct<Term:string,Description:string>>").alias("AlternateTerms")
    entry = F.struct(F.col("p_partkey").cast("string").alias("entry_id"), F.col("p_name").alias("Name"), F.col("p_brand").alias("Abstraction"), F.col("p_type").alias("Description"), terms, F.array(one).alias("RelatedWeaknesses"))
    return st.table(spark, sf_dir, "part").select("p_partkey", F.to_json(tx.embedding_document(entry)).alias("document"))


# -- answers

@query(
    """SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'resolution' WHEN 1 THEN 'criticism' WHEN 2 THEN 'analysis' ELSE 'other' END AS kind,
  CASE item_id % 4 WHEN 0 THEN '# Final Resolution for X' || chr(10) || text || chr(10) WHEN 1 THEN '# Summary' || chr(10) || 'short' WHEN 2 THEN '# A' || chr(10) || text || chr(10) || '|# B' || chr(10) || 'end' ELSE text END AS parts FROM benchmark"""
)
def typed_segments(spark, sf_dir):
    """Documents of each kind, with the block that the kind asks for, without it, with several parts, and without headings."""
    at = (F.col("item_id") % 4).cast("int")
    name = F.get(F.array(*[F.lit(f"x_{n}.md") for n in ("resolution", "criticism", "analysis", "notes")]), at)
    text = F.get(
        F.array(
            F.concat(F.lit("intro\n# Final Resolution for X\n"), "text", F.lit("\n# Summary\nshort")),
            F.concat(F.lit("# Other\n"), "text", F.lit("\n# Summary\nshort")),
            F.concat(F.lit("# A\n"), "text", F.lit("\n# B\nend")),
            F.col("text"),
        ),
        at,
    )
    rows = st.table(spark, sf_dir, "benchmark").select("item_id", evaluate.document_kind(name).alias("kind"), text.alias("text"))
    return rows.select("item_id", "kind", F.array_join(evaluate.typed_segments(F.col("text"), F.col("kind")), "|").alias("parts"))


@query(f"WITH {ANSWERS}, a AS (SELECT record_id, list_sort(list_distinct(list(entry_id))) AS ids FROM given WHERE source = 'even' GROUP BY 1), c AS (SELECT record_id, list_sort(list_distinct(list(entry_id))) AS ids FROM given WHERE source = 'odd' GROUP BY 1) SELECT coalesce(a.record_id, c.record_id) AS record_id, array_to_string(list_concat(coalesce(a.ids, []), list_filter(coalesce(c.ids, []), lambda x: NOT list_contains(coalesce(a.ids, []), x))), ',') AS ids FROM a FULL JOIN c ON a.record_id = c.record_id")
def prior_ids(spark, sf_dir):
    given = _given(spark, sf_dir)
    of = lambda s: given.where(F.col("source") == s).groupBy("record_id").agg(F.sort_array(F.collect_set("entry_id")).alias("ids"))
    return evaluate.prior_ids(of("even"), of("odd")).select("record_id", listed("ids").alias("ids"))


def _given(spark, sf_dir):
    from weavegrid.plans.catalogue import _answers

    return _answers(spark, sf_dir)[0]


def _true(spark, sf_dir):
    from weavegrid.plans.catalogue import _answers

    return _answers(spark, sf_dir)[1]


@query(f"WITH {HITS_SQL}, b AS (SELECT query_id, entry_id, max(score) AS score FROM hits GROUP BY ALL) SELECT query_id, string_agg(CAST(entry_id AS VARCHAR), ',' ORDER BY score DESC, entry_id) AS ids FROM b GROUP BY query_id")
def detected_ids(spark, sf_dir):
    return evaluate.detected_ids(st.hits(spark, sf_dir)).select("query_id", listed("ids").alias("ids"))


@query(
    f"""WITH {_COMPARED} SELECT CAST(record_id AS VARCHAR) AS record_id, '## ' || record_id || chr(10) || '- matched: **' || CASE WHEN len(matched) > 0 THEN array_to_string(matched, ', ') ELSE 'none' END || '**' || chr(10) || '- benchmark only: ' || CASE WHEN len(truth_only) > 0 THEN array_to_string(truth_only, ', ') ELSE 'none' END
  || chr(10) || '- results only: ' || CASE WHEN len(results_only) > 0 THEN array_to_string(results_only, ', ') ELSE 'none' END AS report FROM compared"""
)
def comparison_sections(spark, sf_dir):
    return evaluate.comparison_report(_compared(spark, sf_dir).withColumn("record_id", F.col("record_id").cast("string")))


_SOURCES = [*sinks.BENCHMARK_SOURCES, "retrievers"]
_IDS_OF = "coalesce(string_agg(DISTINCT entry_id, ';' ORDER BY entry_id) FILTER ({}), '') AS {}"


@query(
    f"""WITH {ANSWERS}, sourced AS (SELECT l_orderkey AS record_id, [{", ".join(f"'{s}'" for s in _SOURCES)}][1 + (l_linenumber + l_suppkey) % {len(_SOURCES)}] AS source, CAST(l_suppkey % 50 AS VARCHAR) AS entry_id FROM lineitem WHERE l_returnflag <> 'R'),
b AS (SELECT record_id, string_agg(DISTINCT entry_id, ';' ORDER BY entry_id) AS ids FROM truth GROUP BY 1),
m AS (SELECT record_id, string_agg(DISTINCT entry_id, ';' ORDER BY entry_id) AS ids FROM sourced SEMI JOIN truth USING (record_id, entry_id) GROUP BY 1),
s AS (SELECT record_id, {", ".join(_IDS_OF.format(f"source = '{s}'", c) for s, c in sinks.BENCHMARK_SOURCES.items())} FROM sourced GROUP BY 1)
SELECT s.record_id AS CVE, s.* EXCLUDE (record_id), coalesce(b.ids, '') AS Benchmark_CWEs, coalesce(m.ids, '') AS Matched_CWEs FROM s LEFT JOIN b ON b.record_id = s.record_id LEFT JOIN m ON m.record_id = s.record_id"""
)
def benchmark_table(spark, sf_dir):
    """Order lines that weren't returned as answers of eleven sources, open ones as the truth."""
    rows = st.table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'")
    source = F.array(*map(F.lit, _SOURCES))[((F.col("l_linenumber") + F.col("l_suppkey")) % len(_SOURCES)).cast("int")]
    given = rows.select(F.col("l_orderkey").alias("record_id"), source.alias("source"), (F.col("l_suppkey") % 50).cast("string").alias("entry_id"))
    return sinks.benchmark_csv(given, _true(spark, sf_dir))


@query(f"WITH {_FUSED}, r AS (SELECT *, {_RANK} FROM fused) SELECT query_id AS record_id, string_agg(CAST(entry_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM r WHERE rank <= 3 GROUP BY query_id")
def top_as_primary(spark, sf_dir):
    fused = fusion.fuse(st.hits(spark, sf_dir), F.broadcast(st.entries(spark, sf_dir)), 5)
    ranked = fused.select(F.col("query_id").alias("record_id"), "rank", F.col("entry_id").cast("string").alias("entry_id"))
    return evaluate.merged_answers(evaluate.top_as_primary(ranked)).select("record_id", listed("primary").alias("ids"))


@query(f"WITH {ANSWERS} SELECT record_id, entry_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM given GROUP BY record_id, entry_id")
def ids_to_sources(spark, sf_dir):
    rows = evaluate.id_sources(_given(spark, sf_dir))
    return rows.select("record_id", F.explode("sources_of").alias("entry_id", "sources")).withColumn("sources", listed("sources"))


@query(
    """WITH l AS (SELECT l_orderkey AS record_id, l_linenumber AS file, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM lineitem GROUP BY 1, 2)
SELECT record_id, arg_min(flag, file) AS flag, arg_min(CASE WHEN file > 1 THEN status END, CASE WHEN file > 1 THEN file END) AS status, string_agg('f' || file, ',' ORDER BY file) AS sources FROM l GROUP BY record_id"""
)
def merged_metadata(spark, sf_dir):
    items = st.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("file"), "l_returnflag", "l_linestatus")
    rows = evaluate.by_record(items).groupBy("record_id", "file").agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    files = rows.select("record_id", "file", F.concat(F.lit("f"), "file").alias("name"), F.create_map(F.lit("flag"), "flag", F.lit("status"), F.when(F.col("file") > 1, F.col("status"))).alias("metadata"))
    found = evaluate.merged_metadata(files)
    return found.select("record_id", F.col("metadata")["flag"].alias("flag"), F.col("metadata")["status"].alias("status"), listed("sources").alias("sources"))


# -- summaries and reports

_RECORDS = "SELECT o_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), '|' ORDER BY l_linenumber, l_suppkey) AS ids, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' GROUP BY o_orderkey"


def _records(spark, sf_dir):
    """Orders as processed records, and those of one status as failed ones."""
    orders, items = st.table(spark, sf_dir, "orders"), st.table(spark, sf_dir, "lineitem")
    ids = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("l"))
    done = orders.where("o_orderstatus <> 'P'").join(ids, "o_orderkey")
    done = done.select(F.col("o_orderkey").cast("string").alias("record_id"), F.transform("l", lambda x: x["l_suppkey"].cast("string")).alias("ids"), (F.col("o_orderkey") % 8000 * 0.25).alias("seconds"))
    return done, orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("record_id"))


@query(
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS "CVE_ID", ids AS "Detected_CWEs", format('{{:,.2f}}', (o_orderkey % 8000 * 0.25)::DOUBLE) AS "Processing_Time" FROM ({_RECORDS})
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'ERROR', '0.00' FROM orders WHERE o_orderstatus = 'P'"""
)
def run_summary(spark, sf_dir):
    return sinks.run_summary(*_records(spark, sf_dir))


@query(f"SELECT count(*) AS n_processed, CAST(sum(n) AS BIGINT) AS n_ids, CAST(0 AS BIGINT) AS n_without, round(sum((o_orderkey % 8000 * 0.25)::DOUBLE), 2) AS seconds, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS n_failed FROM ({_RECORDS})")
def run_metrics(spark, sf_dir):
    return reports.run_metrics(*_records(spark, sf_dir)).withColumn("seconds", F.round("seconds", 2))


@query("SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'CVE-' ELSE 'X-' END || l_orderkey AS query_id, l_linenumber AS rank, l_partkey AS entry_id, l_quantity AS score FROM lineitem WHERE l_orderkey % 2 = 0 AND l_linenumber <= 3")
def search_log(spark, sf_dir):
    rows = st.table(spark, sf_dir, "lineitem")
    name = F.concat(F.when(F.col("l_orderkey") % 2 == 0, "CVE-").otherwise("X-"), F.col("l_orderkey").cast("string"))
    return sinks.search_log(rows.select(name.alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("entry_id"), F.col("l_quantity").alias("score")), 3)


@query("SELECT doc_id AS entry_id, lang AS usage, CASE WHEN length(text) > 100 THEN substring(text, 1, 97) || '...' ELSE text END AS rationale, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS description FROM documents")
def shortened_tables(spark, sf_dir):
    """Rationales of a mapping table and descriptions of a preview, cut."""
    docs = st.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.col("lang").alias("usage"), F.col("text").alias("rationale"), F.col("text").alias("description"))
    cut = reports.mapping_table(docs)
    return cut.join(sinks.preview(docs).select("entry_id", "description"), "entry_id")


@query(
    """WITH p AS (SELECT CAST(l_suppkey % 50 AS VARCHAR) AS id, count(*) AS c FROM lineitem GROUP BY 1 ORDER BY c DESC, id LIMIT 10), s AS (SELECT 'S' || l_linenumber AS id, count(*) AS c FROM lineitem WHERE l_linenumber > 1 GROUP BY 1 ORDER BY c DESC, id LIMIT 10)
SELECT '# Summary' || chr(10) || (SELECT count(*) FROM lineitem) || ' records, ' || (SELECT count(*) FROM lineitem WHERE l_linenumber > 1) || ' with a consensus' || chr(10) || chr(10) || '## primary' || chr(10) || (SELECT string_agg('- ' || id || ': ' || c, chr(10) ORDER BY c DESC, id) FROM p)
 || chr(10) || chr(10) || '## consensus' || chr(10) || (SELECT string_agg('- ' || id || ': ' || c, chr(10) ORDER BY c DESC, id) FROM s) AS report"""
)
def summary_report(spark, sf_dir):
    rows = st.table(spark, sf_dir, "lineitem").select(F.array((F.col("l_suppkey") % 50).cast("string")).alias("primary"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("S"), "l_linenumber")).alias("consensus"))
    return reports.summary_report(rows)


@query(
    """SELECT 'C' || c_custkey AS record_id, '# C' || c_custkey || chr(10) || chr(10) || '## Description' || chr(10) || c_name || chr(10) || chr(10) || '## Keyphrases' || chr(10) || '- weakness: ' || c_mktsegment || chr(10) || chr(10) || '## Analysis' || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'none' END
 || chr(10) || chr(10) || '## Criticism' || chr(10) || 'c' || c_nationkey || chr(10) || chr(10) || '## Resolution' || chr(10) || 'done' AS report FROM customer"""
)
def final_reports(spark, sf_dir):
    rows = st.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), "c_custkey").alias("record_id"),
        F.col("c_name").alias("description"),
        F.create_map(F.lit("weakness"), F.array("c_mktsegment")).alias("phrases"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("analysis"),
        F.concat(F.lit("c"), "c_nationkey").alias("criticism"),
        F.lit("done").alias("resolution"),
    )
    return reports.final_report(rows)


@query(
    f"""WITH {GRAPH_SQL}, related AS (
  SELECT src AS entry_id, 'CHILDOF' AS rel_type, dst FROM hierarchy WHERE src LIKE 'N%' UNION ALL SELECT dst, 'PARENTOF', src FROM hierarchy WHERE dst LIKE 'N%'
), first AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY rel_type, dst) AS n FROM related),
one AS (SELECT entry_id, '#### ' || entry_id || ' Relationships' || chr(10) || string_agg('- ' || rel_type || ' → ' || dst, chr(10) ORDER BY n) AS t FROM first WHERE n <= 5 GROUP BY entry_id),
hits AS (SELECT c_custkey, r AS rank, 'N' || (c_nationkey + r) % 25 AS entry_id, (c_nationkey + r) % 25 AS n_nationkey FROM customer, range(1, 10) x(r)),
relations AS (SELECT c_custkey, string_agg(t, chr(10) ORDER BY rank) AS relations FROM hits JOIN one USING (entry_id) WHERE rank <= 7 GROUP BY c_custkey),
tables AS (SELECT c_custkey, string_agg('| ' || rank || ' | ' || entry_id || ' | ' || n_name || ' | ' || format('{{:.4f}}', 1.0::DOUBLE / rank) || ' |', chr(10) ORDER BY rank) AS t FROM hits JOIN nation USING (n_nationkey) GROUP BY c_custkey)
SELECT c.c_custkey AS record_id, concat_ws(chr(10) || chr(10), '## Description' || chr(10) || c_name, '## Keyphrases' || chr(10) || 'weakness: ' || c_mktsegment,
  CASE WHEN n.n_nationkey % 2 = 0 THEN '## Consensus' || chr(10) || n_name END, CASE WHEN c.c_custkey % 3 = 0 THEN '## References' || chr(10) || 'see ' || c_name END,
  '## Candidates' || chr(10) || '| rank | id | name | score |' || chr(10) || '|---|---|---|---|' || chr(10) || t.t, '## Relations' || chr(10) || relations) AS prompt
FROM customer c LEFT JOIN nation n ON c_nationkey = n_nationkey JOIN tables t ON t.c_custkey = c.c_custkey LEFT JOIN relations r ON r.c_custkey = c.c_custkey"""
)
def assembled_prompts(spark, sf_dir):
    """Customers with nine nations as candidates; relations of the first seven, five each."""
    customer, nations = st.table(spark, sf_dir, "customer"), st.table(spark, sf_dir, "nation")
    records = customer.select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("description"), F.create_map(F.lit("weakness"), F.array("c_mktsegment", F.lit(" "))).alias("phrases"))
    agreed = customer.join(F.broadcast(nations.where("n_nationkey % 2 = 0")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("record_id"), F.col("n_name").alias("consensus"))
    hits = customer.select(F.col("c_custkey").alias("query_id"), "c_nationkey", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("rank")).withColumn("n_nationkey", (F.col("c_nationkey") + F.col("rank")) % 25)
    hits = hits.join(F.broadcast(nations.select("n_nationkey", F.col("n_name").alias("name"))), "n_nationkey").select("query_id", "rank", F.concat(F.lit("N"), "n_nationkey").alias("entry_id"), "name", (1 / F.col("rank")).alias("score"))
    references = customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("record_id"), F.concat(F.lit("see "), "c_name").alias("text"))
    edges = graph.with_reciprocals(st.hierarchy(spark, sf_dir))
    return reports.enhanced_query(records, agreed, reports.result_table(hits), reports.relations_of_first(hits, edges), references)


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS record_id, '### CWE-' || n_nationkey || ': ' || n_name || chr(10) || 'about ' || n_name || chr(10) || 'Mitigations:' || chr(10) || '- ' || n_name || ' a' || chr(10) || '- ' || n_name || ' b' || chr(10) || '- ' || n_name || ' c' AS specifications FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def specifications(spark, sf_dir):
    asked = st.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("record_id"), F.concat(F.lit("cwe "), "c_nationkey").alias("entry_id"))
    name = F.col("n_name")
    entries = st.table(spark, sf_dir, "nation").select(F.concat(F.lit("CWE-"), "n_nationkey").alias("entry_id"), name.alias("name"), F.concat(F.lit("about "), name).alias("description"), F.array(*[F.concat(name, F.lit(f" {x}")) for x in "abcd"]).alias("mitigations"), F.lit(None).cast("array<string>").alias("examples"))
    return reports.specifications(asked, entries)


@query("SELECT o_orderkey AS record_id, o_orderpriority AS description, o_orderstatus AS reference, CASE WHEN o_orderstatus = 'F' THEN 'S' || o_custkey END AS consensus, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE 0 END AS votes FROM orders")
def bundles(spark, sf_dir):
    orders = st.table(spark, sf_dir, "orders")
    records = orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("description"))
    references = orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("text"))
    insight = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("record_id"), F.concat(F.lit("S"), "o_custkey").alias("consensus"), F.col("o_custkey").alias("votes"))
    return reports.bundle(records, references, consensus.empty_insight(records.select("record_id"), insight))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def json_round_trip(spark, sf_dir):
    rows = st.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return reports.as_json(rows, "c_custkey").select(F.from_json("json", rows.schema).alias("row")).select("row.*")


@query(
    f"""WITH {USAGE_LOG_SQL}, r AS (SELECT record_id, sum(input_words) AS i, sum(output_words) AS o FROM log GROUP BY record_id), c AS (SELECT i / 0.75::DOUBLE / 1000 * 0.0001::DOUBLE + o / 0.75::DOUBLE / 1000 * 0.0004::DOUBLE AS cost FROM r)
SELECT count(*) AS n, round(avg(cost), 6) AS average, round(min(cost), 6) AS least, round(max(cost), 6) AS largest, round(sum(cost), 4) AS total FROM c"""
)
def cost_summary(spark, sf_dir):
    log = st.usage_log(spark, sf_dir).groupBy("record_id").agg(F.sum("input_words").alias("sum_input_words"), F.sum("output_words").alias("sum_output_words"))
    rows = usage.cost_summary(usage.priced(log))
    return rows.withColumns({c: r6(c) for c in ("average", "least", "largest")}).withColumn("total", F.round("total", 4))


_ADVICE = f"""{GRAPH_SQL}, edges AS (SELECT src, dst, rel_type FROM hierarchy UNION SELECT dst, src, 'PARENTOF' FROM hierarchy),
seeds AS (SELECT 'q' || n_nationkey AS seed, 'N' || n_nationkey AS node, CASE WHEN n_nationkey % 2 = 0 THEN 'Supplier 00000000' || n_nationkey || ' and others' END AS description FROM nation),
rows AS (SELECT seed, node, description, dst AS other, CASE rel_type WHEN 'PARENTOF' THEN 'child' ELSE 'parent' END AS role FROM seeds JOIN edges ON src = node),
pairs AS (SELECT DISTINCT seed AS query_id, other AS doc_id, name AS text FROM rows JOIN nodes ON id = other WHERE role <> 'parent' AND description IS NOT NULL UNION ALL SELECT seed, NULL, description FROM seeds WHERE description IS NOT NULL),
counts AS (SELECT query_id, doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT query_id, doc_id, unnest(list_filter({_TOKENS}, lambda x: length(x) >= 2)) AS term FROM pairs) GROUP BY query_id, doc_id, term),
fit AS (SELECT query_id, count(*)::DOUBLE AS n FROM pairs GROUP BY query_id),
terms AS (SELECT query_id, term, count(*)::DOUBLE AS df FROM counts GROUP BY query_id, term),
weights AS (SELECT query_id, doc_id, term, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM counts JOIN terms USING (query_id, term) JOIN fit USING (query_id)),
norms AS (SELECT query_id, doc_id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY query_id, doc_id),
unit AS (SELECT w.query_id, w.doc_id, term, w / norm AS u FROM weights w JOIN norms m ON w.query_id = m.query_id AND w.doc_id IS NOT DISTINCT FROM m.doc_id),
near AS (SELECT a.query_id, a.doc_id, sum(a.u * q.u) AS relevance FROM unit a JOIN unit q ON a.query_id = q.query_id AND a.term = q.term AND q.doc_id IS NULL WHERE a.doc_id IS NOT NULL GROUP BY a.query_id, a.doc_id HAVING sum(a.u * q.u) > 0.1),
advice AS (SELECT seed, node, other, role, CASE WHEN role = 'parent' OR description IS NULL THEN 0.5::DOUBLE ELSE round(coalesce(relevance, 0), 6) END AS relevance FROM rows LEFT JOIN near ON query_id = seed AND doc_id = other),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY seed, node, role ORDER BY relevance DESC, other) AS INTEGER) AS rank FROM advice)"""


def _advice(spark, sf_dir):
    nodes = st.nodes(spark, sf_dir)
    k = F.col("n_nationkey").cast("string")
    seeds = st.table(spark, sf_dir, "nation").select(F.concat(F.lit("q"), k).alias("seed"), F.concat(F.lit("N"), k).alias("node"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Supplier 00000000"), k, F.lit(" and others"))).alias("description"))
    edges = graph.with_reciprocals(st.hierarchy(spark, sf_dir), nodes)
    return graph.ranked_advice(edges, seeds, nodes.select("id", F.col("name").alias("text"))), seeds, edges


@query(f"WITH {_ADVICE} SELECT seed, node, other, role, relevance, rank FROM ranked")
def ranked_advice(spark, sf_dir):
    return _advice(spark, sf_dir)[0]


@query(
    f"""WITH {_ADVICE}, roles AS (SELECT seed, string_agg('- ' || role || ': ' || n, chr(10) ORDER BY role) AS roles FROM (SELECT seed, role, count(*) AS n FROM ranked GROUP BY ALL) GROUP BY seed),
specific AS (SELECT seed, string_agg('- ' || other || ' (' || format('{{:.2f}}', relevance) || ')', chr(10) ORDER BY rank) AS specifics FROM ranked WHERE role = 'child' AND rank <= 3 GROUP BY seed)
SELECT s.seed, concat_ws(chr(10) || chr(10), '## Relations' || chr(10) || roles, '## More specific' || chr(10) || specifics, '## Chain' || chr(10) || '- ROOT ' || node || chr(10) || '- EFFECT ' || dst,
  '## Diagram' || chr(10) || '```mermaid' || chr(10) || 'graph TD' || chr(10) || '    ' || node || '["' || a.name || '"]' || chr(10) || '    ' || dst || '["' || b.name || '"]' || chr(10) || '    ' || node || ' -->|canprecede| ' || dst || chr(10) || '```') AS analysis
FROM seeds s LEFT JOIN roles USING (seed) LEFT JOIN specific USING (seed) JOIN hierarchy h ON h.src = node JOIN nodes a ON a.id = node JOIN nodes b ON b.id = dst"""
)
def combined_analysis(spark, sf_dir):
    """Nations with a chain to their region, in words and as a diagram."""
    advice, seeds, _ = _advice(spark, sf_dir)
    nodes, starts = st.nodes(spark, sf_dir), seeds.select("seed", "node")
    follows = st.hierarchy(spark, sf_dir).where("src like 'N%'").withColumn("rel_type", F.lit("CANPRECEDE"))
    found, inside = graph.neighbourhood(graph.steps(follows), starts, GRAPH.sequence, 1)
    diagrams = graph.mermaid(found.where("level = 0 or node like 'R%'").join(nodes.withColumnRenamed("id", "node"), "node").select("seed", F.col("node").alias("id"), "name"), inside)
    return reports.combined_analysis(advice, graph.chain_positions(follows, starts), diagrams=diagrams)

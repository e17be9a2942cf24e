"""Queries of what is kept between runs or comes in any shape: logs as streams, memo tables, nested results, model calls that fail."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weavegrid.functions import hooks
from weavegrid.operators import memo, nested, usage
from weavegrid.operators.scratch import shared_folder
from weavegrid.plans import standins as st
from weavegrid.plans.catalogue import _SQL, query, r6
from weavegrid.streaming import usage_log


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/weavegrid-{name}-{uuid.uuid4().hex}"


@query(_SQL["usage_by_stage"])
def usage_stream(spark, sf_dir):
    """The log of all conversations as files, each delivered twice, through the stream; its appended rows give the batch's roll-up."""
    log = st.usage_log(spark, sf_dir)
    rows = log.select(F.col("record_id").alias("cve_id"), "stage", F.timestamp_seconds(F.col("record_id") * 1000 + F.col("pos") + 86400).alias("timestamp"), *usage.MEASURES)
    source, out, state = (_folder(spark, f"usage-{x}") for x in ("in", "out", "state"))
    for _ in range(2):
        rows.write.mode("append").csv(source, header=True)
    usage_log.append(usage_log.usage_stream(spark, source, "36500 days"), out, state).awaitTermination()
    totals = usage_log.stage_totals(usage_log.appended(spark, out))
    return totals.withColumns({f"avg_{m}": r6(f"avg_{m}") for m in usage.MEASURES})


@query(
    """WITH first AS (SELECT DISTINCT o_orderpriority AS content FROM orders),
asked AS (SELECT o_orderkey, o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ' ' || o_orderstatus END AS content FROM orders),
counts AS (SELECT count(*) FILTER (content IN (SELECT content FROM first)) AS n_found, count(*) FILTER (content NOT IN (SELECT content FROM first)) AS n_made FROM (SELECT DISTINCT content FROM asked))
SELECT o_orderkey, content, content || ' [' || length(content) || ']' AS context, n_found, n_made FROM asked, counts"""
)
def remembered_contexts(spark, sf_dir):
    """Contexts of the second of two runs over all orders, which asks the model only for contents that the first didn't have."""
    orders = st.table(spark, sf_dir, "orders")
    path = _folder(spark, "memo")
    memo.remembered(orders.select(F.col("o_orderpriority").alias("content")), path)
    second = orders.select("o_orderkey", F.concat("o_orderpriority", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit(" "), "o_orderstatus"))).alias("content"))
    rows, counts = memo.remembered(second, path)
    return rows.select("o_orderkey", "content", "context", F.lit(counts["found"]).cast("long").alias("n_found"), F.lit(counts["made"]).cast("long").alias("n_made"))


@query(
    """WITH lines AS (SELECT CAST(l_orderkey AS VARCHAR) AS record_id, 'CWE-' || l_partkey % 50 AS entry_id, l_linenumber AS n FROM lineitem)
SELECT DISTINCT record_id, source, entry_id FROM (
  SELECT record_id, 'primary_cwes' AS source, entry_id FROM lines WHERE n = 1
  UNION ALL SELECT record_id, 'secondary_cwes', entry_id FROM lines WHERE n = 2
  UNION ALL SELECT record_id, 'consensus_cwe', min(entry_id) FROM lines GROUP BY record_id
  UNION ALL SELECT record_id, 'top_similar_cwes', entry_id FROM lines
  UNION ALL SELECT record_id, 'retrievers', entry_id FROM lines
  UNION ALL SELECT record_id, 'retriever_dense', entry_id FROM lines WHERE n % 2 = 1
  UNION ALL SELECT record_id, 'retriever_graph', entry_id FROM lines WHERE n % 3 = 0
  UNION ALL SELECT record_id, 'agents_resolution', entry_id FROM lines WHERE n = 1)"""
)
def nested_result_ids(spark, sf_dir):
    """Order lines as JSON results, half of them in objects keyed by order and half in lists, with similar ids in lists up to four deep."""
    entry, n = F.concat(F.lit("CWE-"), (F.col("l_partkey") % 50).cast("string")), F.col("l_linenumber")
    quoted = F.concat(F.lit('"'), entry, F.lit('"'))
    deep = F.when(n % 4 == 0, quoted).when(n % 4 == 1, F.concat(F.lit("["), quoted, F.lit("]"))).when(n % 4 == 2, F.concat(F.lit('[[{"cwe_id":'), quoted, F.lit("}]]"))).otherwise(F.concat(F.lit("[7, [["), quoted, F.lit(", null]]]")))
    hit = F.concat(F.lit('{"cwe_id":'), quoted, F.lit(',"normalized_scores":{"sparse":null'), F.when(n % 2 == 1, ',"dense":0.5').otherwise(',"dense":null'), F.when(n % 3 == 0, ',"graph":0').otherwise(""), F.lit("}}"))
    agent = F.when(n == 1, F.concat(quoted, F.lit(':{"resolution":{"name":"x"},"analysis":{"name":""}}')))
    rows = st.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        *[F.array_join(F.collect_set(c), ",").alias(name) for name, c in (("top", deep), ("hits", hit), ("agents", agent), ("first", F.when(n == 1, quoted)), ("second", F.when(n == 2, quoted)))],
        F.min(entry).alias("consensus"),
    )
    result = F.concat(
        F.lit('"primary_cwes":['), "first", F.lit('],"secondary_cwes":['), "second", F.lit('],"top_similar_cwes":['), "top", F.lit('],"retrievers":['), "hits",
        F.lit('],"agents":{'), "agents", F.lit('},"consensus_cwe":"'), "consensus", F.lit('"}'),
    )
    key = F.col("l_orderkey").cast("string")
    root = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit('{"'), key, F.lit('":{'), result, F.lit("}"))).otherwise(F.concat(F.lit('[{"cve_id":"'), key, F.lit('",'), result, F.lit("]")))
    return nested.ids_by_source(nested.results_of(rows.select(root.alias("value"))))


def _refusing(prompts: list[str]) -> list[str]:
    if any("7" in p for p in prompts):
        raise RuntimeError("refused")
    return hooks.echo(prompts)


@query("SELECT s_suppkey, CASE WHEN contains(s_name, '7') THEN NULL ELSE s_name || ' [' || length(s_name) || ']' END AS answer, CASE WHEN contains(s_name, '7') THEN 'RuntimeError: refused' END AS error FROM supplier")
def model_answers(spark, sf_dir):
    """A model that refuses some names: their rows have an error, all others an answer."""
    asked = st.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("prompt"))
    return hooks.answered(asked, _refusing).drop("prompt")

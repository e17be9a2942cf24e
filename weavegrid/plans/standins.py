"""The driver's tables in the roles of a knowledge base, a graph, hits, votes and logs; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kind_of(number):
    """An abstraction level for a number."""
    return F.get(F.array(*[F.lit(x) for x in ("Pillar", "Class", "Base", "Variant", "Compound")]), (number % 5).cast("int"))


def usage_of(number):
    return F.get(F.array(*[F.lit(x) for x in ("Allowed", "Allowed-with-Review", "Discouraged", "Prohibited")]), (number % 4).cast("int"))


KIND_SQL = "(['Pillar', 'Class', 'Base', 'Variant', 'Compound'])[CAST({0} % 5 AS INTEGER) + 1]"
USAGE_SQL = "(['Allowed', 'Allowed-with-Review', 'Discouraged', 'Prohibited'])[CAST({0} % 4 AS INTEGER) + 1]"


def questions(spark, sf_dir) -> DataFrame:
    """query_id, text: benchmark passages."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def hits(spark, sf_dir) -> DataFrame:
    """Order lines as hits: the order asks, seven entries answer, the line number names the retriever."""
    rows = table(spark, sf_dir, "lineitem")
    which = F.col("l_linenumber") % 3
    return rows.select(
        F.col("l_orderkey").alias("query_id"),
        (F.col("l_partkey") % 7).alias("entry_id"),
        F.when(which == 0, "dense").when(which == 1, "sparse").otherwise("graph").alias("retriever"),
        F.when(which == 0, F.col("l_discount") * 10).when(which == 1, F.col("l_extendedprice") / 50).otherwise(F.col("l_quantity") / 15.7).alias("score"),
    )


HITS_SQL = """hits AS (
  SELECT l_orderkey AS query_id, l_partkey % 7 AS entry_id,
    CASE l_linenumber % 3 WHEN 0 THEN 'dense' WHEN 1 THEN 'sparse' ELSE 'graph' END AS retriever,
    CASE l_linenumber % 3 WHEN 0 THEN l_discount * 10 WHEN 1 THEN l_extendedprice / 50 ELSE l_quantity / 15.7::DOUBLE END AS score
  FROM lineitem
)"""


def entries(spark, sf_dir) -> DataFrame:
    """The seven entries with abstraction, usage and number of relations."""
    e = F.col("entry_id")
    return spark.range(7).select(F.col("id").alias("entry_id")).select("entry_id", kind_of(e).alias("abstraction"), usage_of(e).alias("usage"), (e % 4).alias("n_relations"))


ENTRIES_SQL = f"""entries AS (
  SELECT entry_id, {KIND_SQL.format('entry_id')} AS abstraction, {USAGE_SQL.format('entry_id')} AS usage, entry_id % 4 AS n_relations FROM range(7) r(entry_id)
)"""


def nodes(spark, sf_dir) -> DataFrame:
    of = lambda t, p, kind: table(spark, sf_dir, t).select(F.concat(F.lit(t[0].upper()), F.col(f"{p}key").cast("string")).alias("id"), F.col(f"{p[0]}_name").alias("name"), F.lit(kind).alias("type"))
    return of("region", "r_region", "Pillar").union(of("nation", "n_nation", "Class")).union(of("supplier", "s_supp", "Base")).union(of("customer", "c_cust", "Variant"))


def hierarchy(spark, sf_dir) -> DataFrame:
    """CHILDOF edges: nation to region, supplier to nation, customer to the first supplier of its nation."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nation, supplier, customer = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    first = supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s"))
    rows = nation.select(key("N", "n_nationkey").alias("src"), key("R", "n_regionkey").alias("dst")).union(supplier.select(key("S", "s_suppkey"), key("N", "s_nationkey")))
    rows = rows.union(customer.join(first, F.col("c_nationkey") == F.col("s_nationkey")).select(key("C", "c_custkey"), key("S", "s")))
    return rows.withColumn("rel_type", F.lit("CHILDOF"))


def sequences(spark, sf_dir) -> DataFrame:
    """CANPRECEDE edges: event types that follow each other within a user's events."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select(before.alias("src"), F.col("event_type").alias("dst"))
    return rows.where("src is not null and src <> dst").distinct().withColumn("rel_type", F.lit("CANPRECEDE"))


def likes(spark, sf_dir) -> DataFrame:
    """PEEROF edges: each part and the next of its brand and size; linear in the parts."""
    after = F.lead("p_partkey").over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey"))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey").alias("src"), F.concat(F.lit("P"), after).alias("dst"))
    return rows.where("dst is not null").withColumn("rel_type", F.lit("PEEROF"))


def event_types(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("seed")).distinct().withColumn("node", F.col("seed"))


GRAPH_SQL = """nodes AS (
  SELECT 'R' || r_regionkey AS id, r_name AS name, 'Pillar' AS type FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 'Class' FROM nation
  UNION ALL SELECT 'S' || s_suppkey, s_name, 'Base' FROM supplier UNION ALL SELECT 'C' || c_custkey, c_name, 'Variant' FROM customer
), hierarchy AS (
  SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst, 'CHILDOF' AS rel_type FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'CHILDOF' FROM supplier
  UNION ALL SELECT 'C' || c_custkey, 'S' || s, 'CHILDOF' FROM customer JOIN (SELECT s_nationkey, min(s_suppkey) AS s FROM supplier GROUP BY s_nationkey) ON c_nationkey = s_nationkey
), sequences AS (
  SELECT DISTINCT src, dst, 'CANPRECEDE' AS rel_type FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_type AS dst FROM events) WHERE src IS NOT NULL AND src <> dst
), likes AS (
  SELECT 'P' || p_partkey AS src, 'P' || dst AS dst, 'PEEROF' AS rel_type FROM (SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS dst FROM part) WHERE dst IS NOT NULL
), event_types AS (SELECT DISTINCT event_type AS seed FROM events)"""


def all_edges(spark, sf_dir) -> DataFrame:
    return hierarchy(spark, sf_dir).union(sequences(spark, sf_dir)).union(likes(spark, sf_dir))


ALL_EDGES_SQL = GRAPH_SQL + ", edges AS (SELECT * FROM hierarchy UNION ALL SELECT * FROM sequences UNION ALL SELECT * FROM likes)"


def votes(spark, sf_dir) -> DataFrame:
    """Order lines as votes: the order is the record, the supplier the entry, the discount the similarity."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("record_id"),
        F.round(100 - 200 * F.col("l_discount")).cast("int").alias("similarity"),
        F.array(F.col("l_suppkey").cast("string")).alias("ids"),
        F.col("l_quantity").cast("long").alias("frequency"),
        (F.col("l_partkey") % 100).alias("total"),
        (F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")).alias("pos"),
    )


VOTES_SQL = """votes AS (
  SELECT l_orderkey AS record_id, CAST(round(100 - 200 * l_discount) AS INTEGER) AS similarity, CAST(l_suppkey AS VARCHAR) AS entry_id,
    CAST(l_quantity AS BIGINT) AS frequency, l_partkey % 100 AS total, CAST(l_linenumber AS BIGINT) * 10000000 + l_partkey AS pos
  FROM lineitem
)"""


def usage_log(spark, sf_dir) -> DataFrame:
    """Conversation turns as usage records: the role is the stage; what one says, the next one reads."""
    from weavegrid.functions.text import word_count

    rows = table(spark, sf_dir, "conversations")
    length, words = F.coalesce(F.length("text"), F.lit(0)).cast("long"), word_count(F.col("text"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.select(F.col("conv_id").alias("record_id"), F.col("role").alias("stage"), F.col("turn").alias("pos"), length.alias("output_length"), words.alias("output_words"), F.coalesce(F.lag(length).over(w), F.lit(0).cast("long")).alias("input_length"), F.coalesce(F.lag(words).over(w), F.lit(0).cast("long")).alias("input_words"))
    return rows


USAGE_LOG_SQL = r"""said AS (
  SELECT conv_id AS record_id, role AS stage, turn AS pos, length(coalesce(text, '')) AS n, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS w FROM conversations
), log AS (
  SELECT record_id, stage, pos, n AS output_length, w AS output_words, coalesce(lag(n) OVER (PARTITION BY record_id ORDER BY pos), 0) AS input_length, coalesce(lag(w) OVER (PARTITION BY record_id ORDER BY pos), 0) AS input_words FROM said
)"""

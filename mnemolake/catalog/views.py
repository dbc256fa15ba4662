"""The given tables seen as a memory store.

Each view has a Spark builder and the same definition as SQL text, so a query
and its SQL twin start from one mapping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import in_parts

NOW = 1706745600.0  # 2024-02-01T00:00:00Z, the fixed clock of every registered query


TEXT_TABLES = {"documents", "conversations"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return in_parts(df) if name in TEXT_TABLES else df


def epoch(col: str):
    return F.col(col).cast("timestamp").cast("double")


def access_log(spark: SparkSession, sf: str) -> DataFrame:
    """events as accesses: user_id is the memory that was read."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("memory_id"), epoch("ts").alias("ts"), "event_id", "event_type", "value", "props"
    )


def access_stats(spark: SparkSession, sf: str) -> DataFrame:
    return access_log(spark, sf).groupBy("memory_id").agg(
        F.count("*").alias("access_count"), F.max("ts").alias("last_ts"), F.min("ts").alias("first_ts")
    )


ACCESS_STATS_SQL = """
SELECT user_id AS memory_id, count(*) AS access_count, max(epoch(ts)) AS last_ts, min(epoch(ts)) AS first_ts
FROM events GROUP BY user_id"""


def memories(spark: SparkSession, sf: str) -> DataFrame:
    """documents (with labels and accesses) as memory rows; longer texts are older."""
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    stats = access_stats(spark, sf)
    created = F.lit(NOW) - F.col("n_chars") * 1800.0
    kind = (
        F.when(F.col("lang") == "en", "fact")
        .when(F.col("lang") == "fr", "preference")
        .when(F.col("lang") == "de", "event")
        .otherwise("observation")
    )
    scope = (
        F.when(F.length("source") == 4, "public").when(F.col("source").endswith("5"), "shared").otherwise("private")
    )
    return (
        docs.join(labels, "doc_id", "left")
        .join(stats, docs.doc_id == stats.memory_id, "left")
        .select(
            F.col("doc_id").alias("memory_id"),
            F.col("text").alias("content"),
            "lang",
            "source",
            kind.alias("memory_type"),
            F.when(F.col("quality") == 1, "pattern").otherwise("instance").alias("memory_level"),
            scope.alias("scope"),
            F.when(scope == "shared", F.array("lang")).alias("shared_with"),
            (F.coalesce("toxic", F.lit(0)) == 1).alias("sensitive"),
            (1.0 + 0.5 * F.coalesce("quality", F.lit(0))).alias("strength"),
            F.coalesce("access_count", F.lit(0)).cast("long").alias("access_count"),
            created.alias("created_at"),
            F.coalesce("last_ts", created).alias("last_accessed"),
            F.lit(False).alias("consolidated"),
        )
    )


MEMORIES_SQL = f"""
SELECT d.doc_id AS memory_id, d.text AS content, d.lang, d.source,
  CASE d.lang WHEN 'en' THEN 'fact' WHEN 'fr' THEN 'preference' WHEN 'de' THEN 'event' ELSE 'observation' END AS memory_type,
  CASE WHEN l.quality = 1 THEN 'pattern' ELSE 'instance' END AS memory_level,
  CASE WHEN length(d.source) = 4 THEN 'public' WHEN d.source LIKE '%5' THEN 'shared' ELSE 'private' END AS scope,
  CASE WHEN length(d.source) <> 4 AND d.source LIKE '%5' THEN [d.lang] END AS shared_with,
  coalesce(l.toxic, 0) = 1 AS sensitive,
  1.0 + 0.5 * coalesce(l.quality, 0) AS strength,
  coalesce(a.access_count, 0) AS access_count,
  {NOW} - d.n_chars * 1800.0::DOUBLE AS created_at,
  coalesce(a.last_ts, {NOW} - d.n_chars * 1800.0::DOUBLE) AS last_accessed
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN ({ACCESS_STATS_SQL}) a ON a.memory_id = d.doc_id"""


def order_concepts(spark: SparkSession, sf: str) -> DataFrame:
    """Concept bridge: an order is a memory, the names of its parts are its concepts."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return (
        items.join(parts, items.l_partkey == parts.p_partkey)
        .groupBy(F.col("l_orderkey").alias("memory_id"), F.col("p_name").alias("concept"))
        .agg(F.min("p_type").alias("category"))
    )


ORDER_CONCEPTS_SQL = """
SELECT l_orderkey AS memory_id, p_name AS concept, min(p_type) AS category
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_name"""


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    """orders as statements: a customer's order priority at a date."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("memory_id"),
        F.concat(F.lit("customer "), F.col("o_custkey").cast("string"), F.lit("|priority")).alias("fact_key"),
        F.col("o_orderpriority").alias("value"),
        F.when(F.col("o_orderstatus") == "F", "negative").otherwise("positive").alias("polarity"),
        epoch("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("price"),
    )


ORDER_FACTS_SQL = """
SELECT o_orderkey AS memory_id, 'customer ' || o_custkey || '|priority' AS fact_key, o_orderpriority AS value,
  CASE WHEN o_orderstatus = 'F' THEN 'negative' ELSE 'positive' END AS polarity,
  epoch(o_orderdate) AS created_at, o_totalprice AS price
FROM orders"""


def passage_queries(spark: SparkSession, sf: str) -> DataFrame:
    """benchmark items as a batch of recall queries."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

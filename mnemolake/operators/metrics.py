"""Retrieval-quality metrics and store dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_relevant_rank(queries: DataFrame, ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query columns, first_rank): best rank of a relevant row, null when none was returned."""
    keys = ["query_id", "memory_id"] if "query_id" in relevant.columns else ["memory_id"]
    hits = ranked.join(relevant.select(*keys).distinct(), keys, "left_semi")
    best = hits.groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return queries.join(best, "query_id", "left")


def ranking_quality(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Recall@1/5/10 and MRR, overall or rolled up by query columns."""
    ranks = first_relevant_rank(queries, ranked, relevant)

    def at(k: int):
        return F.round(F.avg(F.when(F.col("first_rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}")

    grouped = ranks.rollup(*by) if by else ranks.groupBy()
    return grouped.agg(
        F.count("*").alias("n_queries"),
        at(1),
        at(5),
        at(10),
        F.round(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def store_stats(memories: DataFrame) -> DataFrame:
    """Scalar dashboard: counts by liveness, type and scope."""
    live = ~F.coalesce(F.col("consolidated"), F.lit(False))
    return memories.agg(
        F.count("*").alias("n_rows"),
        F.count_if(live).alias("n_active"),
        F.count_if(F.col("sensitive")).alias("n_sensitive"),
        F.countDistinct("memory_type").alias("n_types"),
        F.round(F.avg("strength"), 6).alias("avg_strength"),
        F.min("created_at").alias("first_created"),
        F.max("created_at").alias("last_created"),
        F.sum(F.octet_length("content")).alias("n_bytes"),
    )


def drift(memories: DataFrame, now: float) -> DataFrame:
    """Share of rows that are stale, never read, or superseded patterns."""
    n = F.count("*")

    def share(cond):
        return F.round(F.count_if(cond) / n, 6)

    age = (F.lit(now) - F.col("created_at")) / 86400
    return memories.agg(
        n.alias("active"),
        share(age > 90).alias("older_90d"),
        share(F.col("access_count") == 0).alias("never_read"),
        share(F.col("memory_level") != "instance").alias("abstracted"),
        share(F.col("sensitive")).alias("sensitive"),
    )

"""Scheduled maintenance: one report row over all batch jobs of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import concepts, lifecycle, patterns, similarity


def due(active: int, last_run: float, now: float, rows: int = 100, hours: float = 24.0) -> bool:
    """Whether the job should run: enough rows, or a day since the last run."""
    return active >= rows or now - last_run >= hours * 3600


def sleep_report(
    memories: DataFrame, bridge: DataFrame, activations: DataFrame, now: float, consolidate: bool = True, prune: bool = True
) -> DataFrame:
    """One row: clusters merged, topics promoted, patterns found, rows to prune, concepts merged.

    Each number comes from its own aggregate; the tables behind them are the
    operators' results and are written by the caller.
    """
    dated = bridge.join(memories.select("memory_id", "created_at"), "memory_id")
    found = patterns.cooccurrence_patterns(bridge).select("pattern_type").unionByName(
        patterns.seasonal_patterns(dated).select(F.lit("seasonal").alias("pattern_type"))
    )
    parts = [
        patterns.promotions(memories, bridge).select(F.lit("promoted").alias("job")),
        found.select(F.lit("patterns").alias("job")),
        concepts.merge_near_duplicates(bridge).filter("concept <> keep").select(F.lit("concepts_merged").alias("job")),
    ]
    if consolidate:
        clusters = similarity.consolidation_clusters(memories, bridge)
        merged = clusters.groupBy("component").agg(F.count("*").alias("n")).filter("n >= 3")
        parts.append(merged.select(F.lit("consolidated").alias("job")))
    if prune:
        weak = lifecycle.prune_candidates(memories, bridge, activations, now)
        parts.append(weak.select(F.lit("pruned").alias("job")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    jobs = ["consolidated", "promoted", "patterns", "pruned", "concepts_merged"]
    return rows.agg(*[F.count_if(F.col("job") == j).alias(j) for j in jobs])

"""Scope lattice, caller groups, listing and access-policy receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SCOPES


def scope_rank(scope: Column) -> Column:
    """public 0, shared 1, private 2; anything else counts as private."""
    return F.when(scope == SCOPES[0], 0).when(scope == SCOPES[1], 1).otherwise(2)


def clamp_scope(requested: str, maximum: str) -> str:
    """The requested scope, lowered to what the caller's policy allows."""
    return SCOPES[min(SCOPES.index(requested), SCOPES.index(maximum))]


def block_reason(requested: str, groups: list[str] | None = None) -> Column:
    """Why a row is withheld from the caller, null when it is visible.

    ``groups=None`` means the caller is not restricted to groups; an empty list
    means the caller belongs to none.
    """
    sensitive = F.coalesce(F.col("sensitive"), F.lit(False))
    scope = F.coalesce(F.col("scope"), F.lit("private"))
    out = F.when(sensitive & F.lit(requested != "private"), "sensitive_memory_private_only").when(
        scope_rank(scope) > SCOPES.index(requested), "scope_too_restrictive"
    )
    if groups is not None:
        mine = F.array(*[F.lit(g) for g in groups]).cast("array<string>")
        listed = (scope == "shared") & F.col("shared_with").isNotNull()
        out = out.when(listed & ~F.arrays_overlap("shared_with", mine), "shared_group_missing")
    return out


def visible(requested: str, groups: list[str] | None = None) -> Column:
    return block_reason(requested, groups).isNull()


def list_memories(memories: DataFrame, sort: str = "recent", limit: int = 50, offset: int = 0) -> DataFrame:
    """Page of live rows by last access, creation time or access count."""
    key = {"recent": "last_accessed", "created": "created_at", "access_count": "access_count"}[sort]
    return (
        memories.filter(~F.coalesce(F.col("consolidated"), F.lit(False)))
        .orderBy(F.desc(key), "memory_id")
        .offset(offset)
        .limit(limit)
    )


def receipt(memories: DataFrame, requested: str, groups: list[str] | None, now: float) -> DataFrame:
    """One audit row: rows considered, returned and blocked, with the block reasons."""
    reason = block_reason(requested, groups)
    return memories.select(reason.alias("reason")).agg(
        F.lit(requested).alias("scope_requested"),
        F.count("*").alias("considered"),
        F.count_if(F.col("reason").isNull()).alias("returned"),
        F.count_if(F.col("reason").isNotNull()).alias("blocked"),
        # At most three distinct reasons exist.
        F.array_sort(F.collect_set("reason")).alias("block_reasons"),
        F.lit(now).alias("timestamp"),
    )


def set_scope(memories: DataFrame, ids: DataFrame, scope: str, shared_with: list[str] | None = None) -> DataFrame:
    """Change the scope (and groups) of the listed rows."""
    marked = memories.join(ids.select("memory_id").distinct().withColumn("_hit", F.lit(True)), "memory_id", "left")
    groups = F.array(*[F.lit(g) for g in shared_with]) if shared_with is not None else F.col("shared_with")
    return (
        marked.withColumn("scope", F.when(F.col("_hit"), F.lit(scope)).otherwise(F.col("scope")))
        .withColumn("shared_with", F.when(F.col("_hit"), groups).otherwise(F.col("shared_with")))
        .drop("_hit")
    )


def set_sensitive(memories: DataFrame, ids: DataFrame, value: bool = True) -> DataFrame:
    marked = memories.join(ids.select("memory_id").distinct().withColumn("_hit", F.lit(True)), "memory_id", "left")
    return marked.withColumn("sensitive", F.when(F.col("_hit"), F.lit(value)).otherwise(F.col("sensitive"))).drop("_hit")

"""Versioned beliefs (SCD-2) from dated statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts as fx
from .splits import with_neighbor, with_position


def statements(triples: DataFrame, memories: DataFrame) -> DataFrame:
    """(fact_key, value, polarity, confidence, memory_id, created_at, valid_from) from triples.

    Only the first triple per fact key within one memory speaks.
    """
    t = triples.select(
        "memory_id",
        "seq",
        F.concat_ws("|", fx.norm(F.col("subject")), fx.norm(F.col("predicate"))).alias("fact_key"),
        fx.norm(F.col("object")).alias("value"),
        "polarity",
        "confidence",
    ).filter("value <> ''")
    first = t.groupBy("memory_id", "fact_key").agg(
        F.min_by(F.struct("value", "polarity", "confidence"), "seq").alias("t")
    )
    when = F.coalesce("valid_from", "created_at") if "valid_from" in memories.columns else F.col("created_at")
    dated = memories.select("memory_id", "created_at", when.alias("valid_from"))
    return first.select("memory_id", "fact_key", "t.*").join(dated, "memory_id")


def belief_versions(facts: DataFrame, contradicts: Column | None = None, slice_seconds: float = 86400.0) -> DataFrame:
    """SCD-2 history: a row opens a version when value or polarity changes.

    Order is (created_at, memory_id); ``valid_to`` is the next version's
    ``valid_from``, which may precede this one's for late facts.
    ``contradicts`` is a condition over value, prev_value, polarity and
    prev_polarity that marks a resolved contradiction.
    """
    if "valid_from" not in facts.columns:
        facts = facts.withColumn("valid_from", F.col("created_at"))
    keys = ["fact_key"]
    seen = with_neighbor(facts, keys, "created_at", "memory_id", ["value", "polarity"], False, slice_seconds)
    same = F.col("value").eqNullSafe(F.col("prev_value")) & F.col("polarity").eqNullSafe(F.col("prev_polarity"))
    kept = seen.filter(~same)
    flipped = (F.col("value") == F.col("prev_value")) & (F.col("polarity") != F.col("prev_polarity"))
    reason = F.when(flipped, "user correction")
    if contradicts is not None:
        reason = reason.when(contradicts, "contradiction resolved")
    kept = kept.withColumn("reason", reason.otherwise("new information"))
    out = with_neighbor(kept, keys, "created_at", "memory_id", ["valid_from"], True, slice_seconds)
    return out.withColumnRenamed("next_valid_from", "valid_to")


def current_beliefs(versions: DataFrame) -> DataFrame:
    """Open version per fact key."""
    return versions.filter(F.col("valid_to").isNull())


def belief_history(versions: DataFrame, topic: str) -> DataFrame:
    """Versions whose fact key contains the topic, oldest first."""
    wanted = " ".join(topic.lower().split())
    return versions.filter(F.contains("fact_key", F.lit(wanted))).orderBy("valid_from", "memory_id")


def beliefs_since(versions: DataFrame, cutoff: float) -> DataFrame:
    return versions.filter(F.col("valid_from") >= cutoff)


def belief_report(versions: DataFrame, now: float) -> DataFrame:
    """Current belief per key with its version count and flags."""
    n = versions.groupBy("fact_key").agg(F.count("*").alias("versions"))
    flag = (
        F.when(F.col("confidence") < 0.7, "low confidence")
        .when(F.lit(now) - F.col("valid_from") <= 86400, "recent")
        .otherwise("stable")
    )
    return current_beliefs(versions).join(n, "fact_key").withColumn("flag", flag)


def without_memories(versions_or_triples: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows not introduced by the removed memories."""
    return versions_or_triples.join(ids.select("memory_id"), "memory_id", "left_anti")


def numbered_versions(facts: DataFrame) -> DataFrame:
    """Version number of every statement within its key, with the newest one marked."""
    numbered = with_position(facts, ["fact_key"], "created_at", "memory_id", "version")
    total = facts.groupBy("fact_key").agg(F.count("*").alias("n_versions"))
    return numbered.join(total, "fact_key").withColumn("current", F.col("version") == F.col("n_versions"))

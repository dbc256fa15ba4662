"""Patterns over concepts, episodes and weekdays; promotion of busy topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import EPISODE_WINDOW
from .graph import cooccurrence
from .splits import islands, with_neighbor


def cooccurrence_patterns(bridge: DataFrame, min_support: int = 3) -> DataFrame:
    """(content, pattern_type, support): concept pairs seen in enough memories."""
    return cooccurrence(bridge).filter(F.col("weight") >= min_support).select(
        F.concat(F.lit("User typically does "), "a", F.lit(" on "), "b", F.lit(".")).alias("content"),
        F.lit("co_occurrence").alias("pattern_type"),
        F.col("weight").alias("support"),
    )


def seasonal_patterns(dated: DataFrame, min_support: int = 3, min_ratio: float = 0.66) -> DataFrame:
    """(concept, weekday, n, ratio): concepts that keep to one weekday.

    ``dated`` (memory_id, concept, created_at), UTC. Two partial aggregates.
    """
    day = F.date_format(F.col("created_at").cast("timestamp"), "EEEE")
    by_day = dated.groupBy("concept", day.alias("weekday")).agg(F.count("*").alias("n"))
    best = by_day.groupBy("concept").agg(
        F.max_by("weekday", F.struct("n", "weekday")).alias("weekday"), F.max("n").alias("n"), F.sum("n").alias("total")
    )
    ratio = F.col("n") / F.col("total")
    return best.filter((F.col("n") >= min_support) & (ratio >= min_ratio)).select(
        "concept", "weekday", "n", F.round(ratio, 6).alias("ratio")
    )


def episode_order(episodes: DataFrame) -> DataFrame:
    """(episode_id, place): dense place of each episode by start time.

    Counted per day and offset by running day totals, so no task sorts all episodes.
    """
    day = F.floor(F.col("started_at") / 86400).alias("d")
    base = episodes.select("episode_id", "started_at", day)
    totals = base.groupBy("d").agg(F.count("*").alias("n"))
    # One row per calendar day.
    before = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("d", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    inside = Window.partitionBy("d").orderBy("started_at", "episode_id")
    return (
        base.withColumn("rn", F.row_number().over(inside))
        .join(offsets, "d")
        .select("episode_id", (F.col("off") + F.col("rn")).cast("long").alias("place"))
    )


def streak_patterns(occurrences: DataFrame, episodes: DataFrame, min_episodes: int = 3) -> DataFrame:
    """(concept, max_streak): longest run of consecutive episodes with the concept.

    ``occurrences`` (concept, episode_id). Place minus running count is constant
    within a run; both come from sliced windows, so a concept present
    everywhere does not end in one task.
    """
    seen = occurrences.select("concept", "episode_id").distinct().join(episode_order(episodes), "episode_id")
    near = with_neighbor(seen, ["concept"], "place", "episode_id", ["place"], slice_seconds=4096)
    first = F.col("prev_place").isNull() | (F.col("place") != F.col("prev_place") + 1)
    runs = islands(near, ["concept"], "place", "episode_id", first, slice_seconds=4096)
    lengths = runs.groupBy("concept", "island").agg(F.count("*").alias("n"))
    best = lengths.groupBy("concept").agg(F.max("n").alias("max_streak"))
    return best.filter(F.col("max_streak") >= min_episodes)


def promotions(memories: DataFrame, bridge: DataFrame, min_access: int = 3) -> DataFrame:
    """(concept, access, n_memories): topics read often enough to become semantic memories."""
    raw = memories.filter(~F.col("memory_type").isin("semantic", "consolidated")).select("memory_id", "access_count")
    return (
        bridge.join(raw, "memory_id")
        .groupBy("concept")
        .agg(F.sum("access_count").alias("access"), F.count("*").alias("n_memories"))
        .filter(F.col("access") >= min_access)
    )


def sessions(events: DataFrame, key: str, gap: float) -> DataFrame:
    """Rows with a session number per key: a gap of at least ``gap`` seconds starts a new one."""
    near = with_neighbor(events, [key], "ts", "event_id", ["ts"])
    first = F.col("prev_ts").isNull() | (F.col("ts") - F.col("prev_ts") >= gap)
    return islands(near, [key], "ts", "event_id", first).drop("prev_ts").withColumnRenamed("island", "session")


def named_episodes(rows: DataFrame) -> DataFrame:
    """(episode, started_at, ended_at, n): episodes by name, open without limit."""
    return rows.groupBy("episode").agg(
        F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.count("*").alias("n")
    )


def stale_episodes(episodes: DataFrame, now: float, window: float = EPISODE_WINDOW) -> DataFrame:
    """Episodes whose last row is older than the window."""
    return episodes.filter(F.col("ended_at") < now - window)

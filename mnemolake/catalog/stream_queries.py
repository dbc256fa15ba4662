"""Streams over events and conversations, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import ingest, windows
from . import query
from .text_queries import ROUTER_SQL


def scratch(spark) -> str:
    return scratch_path(spark, "stream")


@query(
    "stream_window_counts",
    """SELECT epoch(date_trunc('day', ts)) AS started_at, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""",
)
def stream_window_counts(spark, sf):
    """Daily windows that the watermark has closed; their state is dropped."""
    out = scratch(spark)
    counts = windows.window_counts(windows.read_events(spark, sf))
    parts = windows.run_available(counts, f"{out}/result", f"{out}/checkpoint")
    return parts.withColumn("total", F.round("total", 2))


@query(
    "stream_sessions",
    """WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
    s AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
    SELECT user_id, round(epoch(min(ts)), 3) AS started_at, count(*) AS n FROM s GROUP BY user_id, k
    HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def stream_sessions(spark, sf):
    """Sessions that the watermark has closed."""
    out = scratch(spark)
    found = windows.session_counts(windows.read_events(spark, sf))
    return windows.run_available(found, f"{out}/result", f"{out}/checkpoint").withColumn("started_at", F.round("started_at", 3))


@query(
    "stream_router",
    f"SELECT result, count(*)::BIGINT AS n FROM ({ROUTER_SQL}) GROUP BY result",
)
def stream_router(spark, sf):
    """Conversations as a message stream through the router: rows per result."""
    out = scratch(spark)
    stream = windows.read_table(spark, sf, "conversations.parquet")
    ingest.start_router(stream, out, f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/receipts").groupBy("result").agg(F.sum("n").alias("n"))

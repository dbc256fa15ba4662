"""Append-only audit receipts and pending-review rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECEIPT = (
    "receipt_id string, decision string, app_id string, purpose string, scope_requested string, scope_applied string, "
    "policy_id string, matched_rules array<string>, memory_counts struct<considered:long, returned:long, blocked:long>, "
    "block_reasons array<string>, timestamp double"
)
PENDING = "id string, content string, memory_type string, metadata string, state string, submitted_at double, changed_at double"


def write_receipts(receipts: DataFrame, path: str) -> None:
    receipts.withColumn("receipt_id", F.coalesce("receipt_id", F.uuid())).write.mode("append").json(path)


def last_receipts(spark: SparkSession, path: str, last: int = 3) -> DataFrame:
    """Newest receipts with defaults for absent fields."""
    rows = spark.read.schema(RECEIPT).json(path)
    none = F.array().cast("array<string>")
    return (
        rows.withColumn("decision", F.coalesce("decision", F.lit("allow")))
        .withColumn("app_id", F.coalesce("app_id", F.lit("unknown")))
        .withColumn("matched_rules", F.coalesce("matched_rules", none))
        .withColumn("block_reasons", F.coalesce("block_reasons", none))
        .orderBy(F.desc("timestamp"), "receipt_id")
        .limit(last)
    )


class Inbox:
    """Pending rows as an append-only table; a row's newest state counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def submit(self, rows: DataFrame, now: float) -> None:
        """``rows`` (content, memory_type, metadata); ids derive from the content."""
        out = rows.select(
            F.sha2(F.concat_ws("|", "content", F.lit(str(now))), 256).alias("id"),
            "content", "memory_type", "metadata",
            F.lit("pending").alias("state"), F.lit(now).alias("submitted_at"), F.lit(now).alias("changed_at"),
        )
        out.write.mode("append").json(self.path)

    def current(self) -> DataFrame:
        log = self.spark.read.schema(PENDING).json(self.path)
        best = log.groupBy("id").agg(F.max_by(F.struct(*log.columns[1:]), "changed_at").alias("r"))
        return best.select("id", "r.*")

    def pending(self) -> DataFrame:
        """Waiting rows, pinned ones first, oldest first."""
        return self.current().filter(F.col("state").isin("pending", "pinned")).orderBy(F.col("state") != "pinned", "submitted_at", "id")

    def _set(self, ids: DataFrame, now: float, state: str | None, content: str | None = None) -> DataFrame:
        rows = self.current().join(ids.select("id"), "id", "left_semi").withColumn("changed_at", F.lit(now))
        if state:
            rows = rows.withColumn("state", F.lit(state))
        if content is not None:
            rows = rows.withColumn("content", F.lit(content))
        rows.write.mode("append").json(self.path)
        return rows

    def approve(self, ids: DataFrame, now: float) -> DataFrame:
        """Mark as approved; the returned rows go to ``remember``."""
        return self._set(ids, now, "approved")

    def reject(self, ids: DataFrame, now: float) -> None:
        self._set(ids, now, "rejected")

    def redact(self, ids: DataFrame, content: str, now: float) -> None:
        self._set(ids, now, None, content)

    def pin(self, ids: DataFrame, now: float) -> None:
        self._set(ids, now, "pinned")

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """Waiting rows by number of occurrences of the text."""
        from ..functions.text import occurrences

        hits = self.pending().withColumn("score", occurrences(F.col("content"), query)).filter("score > 0")
        return hits.orderBy(F.desc("score"), "id").limit(limit)

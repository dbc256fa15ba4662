"""Stream router: classify every message and write it to the sink its route names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as cl


def routed(messages: DataFrame, policy: str = "auto", text: str = "text") -> DataFrame:
    """Stateless step: add result, category, confidence and memory type to each message."""
    sig = messages.withColumn("_sig", cl.signals(F.col(text)))
    return (
        sig.withColumn("result", cl.route(F.col("_sig"), policy))
        .withColumn("category", F.col("_sig.category"))
        .withColumn("confidence", F.col("_sig.confidence"))
        .withColumn("memory_type", cl.memory_type(F.col("_sig.category")))
        .drop("_sig")
    )


def start_router(messages: DataFrame, root: str, checkpoint: str, policy: str = "auto", text: str = "text"):
    """Start the stream: stored, queued and receipt rows go to three parquet folders.

    Each micro-batch writes under its own batch id with overwrite, so a batch
    that is run again after a failure replaces its own output.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        for result, name in (("stored", "memories"), ("queued", "pending")):
            part = rows.filter(F.col("result") == result)
            part.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        rows.groupBy("result").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{root}/receipts/batch={batch_id}")
        rows.unpersist()

    return (
        routed(messages, policy, text)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_seen(messages: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """Drop repeats of a key within the watermark (bounded state)."""
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])

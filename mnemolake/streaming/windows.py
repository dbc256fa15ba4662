"""Event-time windows and sessions over a stream of accesses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table of a folder as a stream, whether it is one file or a folder of part files."""
    schema = spark.read.parquet(f"{path}/{name}").schema
    # As a pattern, the path may be either; a plain path of a stream must be a folder.
    return spark.readStream.schema(schema).parquet(f"{path}/{name[:-1]}[{name[-1]}]")


def read_events(spark: SparkSession, path: str, name: str = "events.parquet") -> DataFrame:
    """The events as a stream; NTZ times become timestamps so that watermarks apply."""
    stream = read_table(spark, path, name)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Rows and summed value per event type and tumbling window."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").cast("double").alias("started_at"), "event_type", "n", "total")
    )


def session_counts(events: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Sessions per user: a silence longer than the gap ends one."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("w.start").cast("double").alias("started_at"), "n")
    )


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, then return the written table."""
    q = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)

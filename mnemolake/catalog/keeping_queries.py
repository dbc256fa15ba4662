"""Streams into versioned stores, tailed log files, and tables of many tenants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import save, scratch_path
from ..sources.tail import TailSource
from ..sources.tenants import TenantTable, tenant_of
from ..streaming.checkpoints import CheckpointSink
from . import query
from .views import table


@query(
    "stream_checkpoints",
    """WITH n AS (SELECT count(*) // 10 AS n FROM events WHERE event_id < (SELECT count(*) // 10 * 10 FROM events))
    SELECT k AS number, 3 * k * n AS rows, 3 * k * n AS ids, 10 * n AS total FROM n, (SELECT unnest([1, 2, 3]) AS k)""",
)
def stream_checkpoints(spark, sf):
    """Ten equal batches of events, a checkpoint after every quarter of all rows, and a batch that runs again."""
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    share = events.count() // 10
    folder = scratch_path(spark, "batches")
    events.filter(F.col("event_id") < share * 10).withColumn("part", F.col("event_id") % 10).repartition("part").write.partitionBy("part").parquet(folder)
    sink = CheckpointSink(spark, scratch_path(spark, "store"), every=10 * share // 4)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    run = stream.writeStream.foreachBatch(sink).option("checkpointLocation", scratch_path(spark, "progress"))
    run.trigger(availableNow=True).start().awaitTermination()
    sink(events.limit(5), 9)
    total = sink.load().count()
    rows = []
    for number, version, n in sink.checkpoints():
        ids = sink.load(version).select("event_id").distinct().count()
        rows.append((number, n, ids, total))
    return spark.createDataFrame(rows, "number long, rows long, ids long, total long")


@query(
    "tail_lines",
    "SELECT user_id, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL",
)
def tail_lines(spark, sf):
    """events as log lines, appended in two steps; the stream is started anew from its checkpoint in between.

    The log folder lies in the folder that driver and executors share.
    """
    events = table(spark, sf, "events").select(F.concat_ws(",", "event_id", "user_id", "event_type").alias("value"), "event_id")
    folder = scratch_path(spark, "logs")
    out, progress = scratch_path(spark, "lines"), scratch_path(spark, "progress")
    spark.dataSource.register(TailSource)

    def catch_up() -> None:
        lines = spark.readStream.format("tail").option("range", 1 << 16).load(folder)
        run = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
        run.trigger(availableNow=True).start().awaitTermination()

    for step in (0, 1):
        events.filter(F.col("event_id") % 2 == step).select("value").write.mode("append").text(folder)
        catch_up()
    cells = F.split("value", ",")
    read = spark.read.parquet(out).select(cells[0].cast("long").alias("event_id"), cells[1].cast("long").alias("user_id"), cells[2].alias("event_type"))
    return read.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "tenant_rows",
    """SELECT event_type, count(*) AS n, round(sum(CASE WHEN user_id % 20 = 3 THEN value * 2 ELSE value END), 2) AS total FROM events WHERE user_id % 20 = 3 GROUP BY event_type""",
)
def tenant_rows(spark, sf):
    """Events of twenty tenants; one tenant's rows are replaced, and that tenant alone is read."""
    events = table(spark, sf, "events").withColumn("tenant", tenant_of(F.col("user_id") % 20)).select("tenant", "event_id", "event_type", "value")
    store = TenantTable(spark, scratch_path(spark, "tenants"))
    store.append(events)
    store.replace(save(store.rows("user-3").withColumn("value", F.col("value") * 2), "replacement"))
    own = store.rows("user-3")
    return own.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "tenant_list",
    "SELECT CASE WHEN user_id % 20 = 0 THEN 'default' ELSE 'user-' || user_id % 20 END AS tenant, count(*) AS n FROM events GROUP BY 1",
)
def tenant_list(spark, sf):
    """Tenants and their row counts; events of users without a number go to the default tenant."""
    user = F.when(F.col("user_id") % 20 > 0, F.col("user_id") % 20)
    store = TenantTable(spark, scratch_path(spark, "tenants"))
    store.append(table(spark, sf, "events").withColumn("tenant", tenant_of(user)).select("tenant", "event_id"))
    return store.tenants()

"""A stream sink that makes a checkpoint whenever enough rows have come in.

Every micro-batch is one version of the store: its rows are staged and then published together with its number, so a
batch that Spark runs again finds its number taken and writes nothing. Once at least ``every`` rows have come since the
last checkpoint, the version is a checkpoint: the pieces since then become one table, and the manifest says how many rows
the checkpoint holds. Counting is by file footers of what was written; no batch is computed twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..sources.versions import VersionedTables


class CheckpointSink:
    """Pass it to ``writeStream.foreachBatch``. One stream writes to one store."""

    def __init__(self, spark: SparkSession, root: str, every: int):
        self.spark, self.every = spark, every
        self.store = VersionedTables(spark, root)

    def __call__(self, rows: DataFrame, batch: int) -> None:
        now = self.store.manifest()
        note = {"batch": -1, "rows": 0, "since": 0, "checkpoints": 0, **now["note"]}
        if batch <= note["batch"]:
            return
        piece = self.store.stage("pieces", rows)
        n = self.spark.read.parquet(piece).count()
        tables = {**now["tables"], f"piece-{batch:012d}": piece}
        note |= {"batch": batch, "rows": note["rows"] + n, "since": note["since"] + n, "checkpoint": False}
        if note["since"] >= self.every:
            pieces = [t for t in tables if t.startswith("piece-")]
            whole = self.spark.read.parquet(*[tables.pop(t) for t in pieces])
            note |= {"since": 0, "checkpoints": note["checkpoints"] + 1, "checkpoint": True}
            tables[f"checkpoint-{note['checkpoints']:012d}"] = self.store.stage("checkpoints", whole)
        self.store.publish(tables, now["version"], note)

    def checkpoints(self) -> list[tuple[int, int, int]]:
        """(number, version, rows) of the checkpoints, oldest first."""
        found = [self.store.manifest(v) for v in self.store.versions()]
        return [(m["note"]["checkpoints"], m["version"], m["note"]["rows"]) for m in found if m["note"].get("checkpoint")]

    def load(self, version: int | None = None) -> DataFrame:
        """Rows of a version, the newest by default: checkpoints and the pieces behind them."""
        return reduce(DataFrame.unionByName, self.store.tables(version).values())

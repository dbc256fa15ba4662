"""Operation log as JSON lines: append, tolerant scan, replay input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from .versions import VersionedTables

SCHEMA = "seq long, timestamp double, operation string, data string"


def append(ops: DataFrame, path: str) -> None:
    """Append (seq, timestamp, operation, data JSON object) rows."""
    line = F.concat(
        F.lit('{"seq":'), F.col("seq").cast("string"), F.lit(',"timestamp":'), F.col("timestamp").cast("string"),
        F.lit(',"operation":"'), "operation", F.lit('","data":'), "data", F.lit("}"),
    )
    ops.select(line.alias("value")).write.mode("append").text(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Log rows; malformed lines are left out, and ``data`` stays raw JSON."""
    log = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
    ids = F.get_json_object("data", "$.id").cast("long")
    return log.filter(F.col("operation").isNotNull()).select("seq", "timestamp", F.col("operation").alias("op"), ids.alias("id"), "data")


def write_snapshot(table: DataFrame, root: str, version: int) -> None:
    """Whole table under a new version folder; readers pick the newest complete one."""
    table.write.mode("errorifexists").parquet(f"{root}/version={version:012d}")


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    versions = spark.read.parquet(root)
    return versions.filter(F.col("version") == versions.agg(F.max("version")).scalar()).drop("version")


class LoggedStore:
    """State of a store as a snapshot and the log behind it.

    The log is a folder of segments, each named by the number of its last entry. ``compact`` commits the present state as
    the next snapshot, together with the number of the last entry in it; readers then skip the segments that the snapshot
    covers, by folder, and pass over covered entries in the others. A compaction that fails half-way leaves the snapshot
    before it in force, and one that is repeated finds nothing new.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.snapshots = VersionedTables(spark, f"{self.root}/snapshots")

    def append(self, ops: DataFrame) -> None:
        """Add entries (seq, timestamp, operation, data JSON object) as one segment."""
        last = ops.agg(F.max("seq")).first()[0]
        if last is not None:
            append(ops, f"{self.root}/log/last={last:020d}")

    def _log(self, upto: int) -> DataFrame:
        lines = self.spark.read.schema(f"{SCHEMA}, last string").option("mode", "DROPMALFORMED").json(f"{self.root}/log")
        new = lines.filter(F.col("last") > f"{upto:020d}")
        return store.entries(new.select("seq", F.col("operation").alias("op"), "data"))

    def _base(self) -> tuple[DataFrame | None, int, int]:
        found = self.snapshots.manifest()
        if not found["tables"]:
            return None, -1, 0
        return self.snapshots.table("state", found["version"]), found["note"]["upto"], found["version"]

    def state(self) -> DataFrame:
        """(kind, key, fields) now: the newest snapshot and all later entries."""
        base, upto, _ = self._base()
        return store.replay_all(self._log(upto), base, upto)

    def compact(self) -> int:
        """Commit the present state as a snapshot; returns the number of the last entry it covers."""
        base, upto, version = self._base()
        log = self._log(upto)
        last = log.agg(F.max("seq")).first()[0]
        if last is None or last <= upto:
            return upto
        state = store.replay_all(log.filter(F.col("seq") <= last), base, upto)
        self.snapshots.commit({"state": state}, based_on=version, note={"upto": last})
        return last

"""Session settings, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "mnemolake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew joins)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors and the driver share.

    Only a single-process session (master local[...], as in tests) may run
    without the setting; it gets a temporary folder. A cluster without it is
    an error, because executors would write to their own disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="mnemolake-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; it survives the loss of the executors that computed it."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; everything below it goes when the application ends."""
    top = f"{shared_folder(spark).rstrip('/')}/mnemolake-{spark.sparkContext.applicationId}"
    fs, p = _hadoop(spark, top)
    if fs.mkdirs(p):
        fs.deleteOnExit(p)
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by ``save`` that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/mnemolake-" in path:
                fs, p = _hadoop(spark, path)
                fs.delete(p, True)


def broadcast_upto(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only when the side is proven to hold at most ``max_rows``.

    The check reads at most ``max_rows + 1`` rows. Beyond the bound the frame
    is returned as it is and the join shuffles on its keys.
    """
    rows = df.limit(max_rows + 1).count()
    return F.broadcast(df) if rows <= max_rows else df


def in_parts(df: DataFrame) -> DataFrame:
    """``df`` dealt round-robin to as many parts as ``mnemolake.table.parts`` says; as it is where that is unset.

    For tests and benches on tables of one small file. A cluster reads a table
    by its file splits and leaves the setting out.
    """
    parts = df.sparkSession.conf.get("mnemolake.table.parts", None)
    return df.repartition(int(parts)) if parts else df


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key.

    Written as a row_number filter, which Spark turns into a group limit that
    runs before the shuffle, so a hot key ships at most k rows per partition.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)

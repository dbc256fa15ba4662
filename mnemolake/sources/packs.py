"""Topic packs: a manifest row with a checksum next to the pack's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slugify
from ..operators.store import signature_diff, table_digest


def topic_memories(
    memories: DataFrame, topic: str, now: float, range_days: int, recalled: DataFrame | None = None, by_concept: DataFrame | None = None
) -> DataFrame:
    """Rows about a topic within the range: recalled, holding the text, or linked to its concepts."""
    recent = memories.filter(F.col("created_at") >= now - range_days * 86400.0)
    text = F.contains(F.lower("content"), F.lit(topic.strip().lower()))
    ids = recent.filter(text).select("memory_id")
    for other in (recalled, by_concept):
        if other is not None:
            ids = ids.union(other.select("memory_id"))
    return recent.join(ids.distinct(), "memory_id", "left_semi")


def save_pack(spark: SparkSession, root: str, topic: str, parts: dict[str, DataFrame], now: float, range_days: int) -> str:
    """Write the pack's tables and a manifest whose checksum covers their digests."""
    slug = spark.range(1).select(slugify(F.lit(topic))).first()[0][:64] or "topic"
    path = f"{root}/{slug}-{int(now)}"
    rows = []
    for name, table in sorted(parts.items()):
        table.write.mode("errorifexists").parquet(f"{path}/{name}")
        stat = table_digest(spark.read.parquet(f"{path}/{name}"), table.columns[0]).first()
        rows.append((topic, range_days, now, name, stat["n"], stat["digest"]))
    manifest = spark.createDataFrame(rows, "topic string, range_days int, created_at double, part string, n long, digest string")
    total = F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "part", "n", "digest"))), "\n"), 256)
    checksum = manifest.agg(total.alias("checksum"))
    manifest.crossJoin(F.broadcast(checksum)).coalesce(1).write.json(f"{path}/manifest")
    return path


def load_pack(spark: SparkSession, path: str, verify: bool = True) -> dict[str, DataFrame]:
    """The pack's tables; raises when a table no longer matches its digest."""
    schema = "topic string, range_days int, created_at double, part string, n long, digest string, checksum string"
    parts = spark.read.schema(schema).json(f"{path}/manifest").collect()
    out = {}
    for row in parts:
        table = spark.read.parquet(f"{path}/{row['part']}")
        if verify and table_digest(table, table.columns[0]).first()["digest"] != row["digest"]:
            raise ValueError(f"checksum mismatch in {path}/{row['part']}")
        out[row["part"]] = table
    return out


def replay(pack_memories: DataFrame, current: DataFrame) -> DataFrame:
    """Signature drift between a pack's rows and the store's present rows on the topic."""
    return signature_diff(pack_memories, current)

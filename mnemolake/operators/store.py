"""Table state: log replay, keyed merges, versions, checkpoints, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def replay(ops: DataFrame, insert: str = "insert_memory", update: str = "update_memory", delete: str = "delete_memory") -> DataFrame:
    """(id, fields): live rows after a log of (seq, op, id, data JSON object).

    Last writer wins per field; an explicit null is a value. Only aggregates:
    the newest value of each field either follows the row's last insert or is
    void, so an id touched by a third of the log still ships one row per task
    and field.
    """
    last = ops.groupBy("id").agg(
        F.max(F.when(F.col("op") == insert, F.col("seq"))).alias("born"),
        F.max(F.when(F.col("op") == delete, F.col("seq"))).alias("died"),
    )
    alive = last.filter("born IS NOT NULL AND (died IS NULL OR born > died)").select("id", "born")
    entries = ops.filter(F.col("op").isin(insert, update)).select(
        "id", "seq", F.explode(F.from_json("data", "map<string,string>")).alias("field", "value")
    )
    newest = entries.groupBy("id", "field").agg(
        F.max("seq").alias("seq"), F.max_by(F.struct("value"), "seq").alias("v")
    )
    kept = newest.join(alive, "id").filter("seq >= born")
    # A row's own fields come back together.
    fields = kept.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "v.value")))).alias("fields"))
    return alive.select("id").join(fields, "id", "left")


# The ten operations of the log: what they change, how, and which field names the row.
OPERATIONS = {
    "insert_memory": ("memory", "insert", "id"),
    "update_memory": ("memory", "update", "id"),
    "delete_memory": ("memory", "delete", "id"),
    "insert_edge": ("edge", "insert", "id"),
    "delete_edge": ("edge", "delete", "id"),
    "insert_episode": ("episode", "insert", "id"),
    "insert_concept": ("concept", "insert", "name"),
    "insert_card": ("card", "insert", "card_id"),
    "update_card": ("card", "update", "card_id"),
    "delete_card": ("card", "delete", "card_id"),
}


def entries(ops: DataFrame) -> DataFrame:
    """(kind, action, key, seq, fields) of log rows (seq, op, data JSON object).

    Unknown operations, data that is no JSON object and rows without a key are left out, as malformed lines are.
    """
    fields = F.from_json("data", "map<string,string>")
    kind = action = key = F.lit(None).cast("string")
    for op, (k, a, name) in OPERATIONS.items():
        this = F.col("op") == op
        kind = F.when(this, k).otherwise(kind)
        action = F.when(this, a).otherwise(action)
        key = F.when(this, F.try_element_at("fields", F.lit(name))).otherwise(key)
    read = ops.withColumn("fields", fields).select(kind.alias("kind"), action.alias("action"), key.alias("key"), "seq", "fields")
    return read.filter("kind IS NOT NULL AND key IS NOT NULL")


def replay_all(log: DataFrame, snapshot: DataFrame | None = None, upto: int = -1) -> DataFrame:
    """(kind, key, fields): the rows of all kinds after ``log`` (see ``entries``) on top of a snapshot.

    ``snapshot`` (kind, key, fields) is the state after entry ``upto``; entries up to there are passed over, so replaying
    a log whose head is already in the snapshot changes nothing. Inserts replace a row, updates overwrite single fields of
    a living one, the last writer wins per field and an explicit null is a value. An edge is void if one of its ends was
    deleted after the edge was inserted; edges inserted later count again. Only aggregates, and one join of the edges with
    the deleted memories.
    """
    rows = log.filter(F.col("seq") > upto)
    if snapshot is not None:
        rows = rows.unionByName(snapshot.select("kind", F.lit("insert").alias("action"), "key", F.lit(upto).cast("long").alias("seq"), "fields"))
    last = rows.groupBy("kind", "key").agg(
        F.max(F.when(F.col("action") == "insert", F.col("seq"))).alias("born"),
        F.max(F.when(F.col("action") == "delete", F.col("seq"))).alias("died"),
    )
    alive = last.filter("born IS NOT NULL AND (died IS NULL OR born > died)").select("kind", "key", "born")
    cells = rows.filter("action <> 'delete'").select("kind", "key", "seq", F.explode("fields").alias("field", "value"))
    newest = cells.groupBy("kind", "key", "field").agg(F.max("seq").alias("seq"), F.max_by(F.struct("value"), "seq").alias("v"))
    kept = newest.join(alive, ["kind", "key"]).filter("seq >= born")
    # A row's own fields come back together.
    pairs = F.sort_array(F.collect_list(F.struct("field", "v.value")))
    state = kept.groupBy("kind", "key", "born").agg(F.map_from_entries(pairs).alias("fields"))
    deaths = last.filter("kind = 'memory' AND died IS NOT NULL").select(F.col("key").alias("end"), F.col("died").alias("cut"))
    edges = state.filter("kind = 'edge'")
    for end in ("source_id", "target_id"):
        edges = (
            edges.withColumn("end", F.try_element_at("fields", F.lit(end)))
            .join(deaths, "end", "left")
            .filter("cut IS NULL OR born > cut")
            .drop("end", "cut")
        )
    return state.filter("kind <> 'edge'").unionByName(edges).select("kind", "key", "fields")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Dict-style merge: columns present in ``changes`` overwrite, others stay; new keys are added."""
    marked = changes.withColumn("_c", F.lit(True)).select(
        key, "_c", *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key]
    )
    joined = base.withColumn("_b", F.lit(True)).join(marked, key, "full_outer")
    cols: list[Column] = [F.col(key)]
    for c in base.columns:
        if c == key:
            continue
        cols.append(F.when(F.col("_c"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns else F.col(c))
    return joined.select(*cols)


def remove(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return base.join(ids.select(key).distinct(), key, "left_anti")


def assign_ids(rows: DataFrame, start: int, order: list[str]) -> DataFrame:
    """Dense new ids after ``start``; ``order`` must identify a row.

    Rows are counted per hash bucket first; a row's id is its bucket's offset
    plus its place inside, so no single task numbers everything. The numbering
    is repeatable but follows the buckets, not ``order``.
    """
    from pyspark.sql import Window

    bucket = F.pmod(F.xxhash64(*order), F.lit(4096))
    keyed = rows.withColumn("_bucket", bucket)
    totals = keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # At most 4096 rows.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_bucket").orderBy(*order)
    return (
        keyed.withColumn("_rn", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_bucket")
        .withColumn("memory_id", (F.lit(start) + F.col("_off") + F.col("_rn")).cast("long"))
        .drop("_bucket", "_off", "_rn")
    )


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: list[str]) -> DataFrame:
    """(key, change, old/new values): added, removed or changed between two snapshots."""
    a = old.select(key, F.struct(*value).alias("o"))
    b = new.select(key, F.struct(*value).alias("n"))
    change = (
        F.when(F.col("o").isNull(), "added")
        .when(F.col("n").isNull(), "removed")
        .when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    )
    out = a.join(b, key, "full_outer").withColumn("change", change).filter(F.col("change").isNotNull())
    return out.select(
        key, "change", *[F.col(f"o.{v}").alias(f"old_{v}") for v in value], *[F.col(f"n.{v}").alias(f"new_{v}") for v in value]
    )


def signature_diff(old: DataFrame, new: DataFrame, text: str = "content") -> DataFrame:
    """(signature, side, n_old, n_new): texts present on one side only, or on both.

    Equal texts are counted on each side before the join.
    """
    sig = F.sha2(F.lower(F.trim(text)), 256)
    a = old.groupBy(sig.alias("signature")).agg(F.count("*").alias("n_old"))
    b = new.groupBy(sig.alias("signature")).agg(F.count("*").alias("n_new"))
    side = F.when(F.col("n_new").isNull(), "missing").when(F.col("n_old").isNull(), "extra").otherwise("match")
    zero = F.lit(0)
    return a.join(b, "signature", "full_outer").select(
        "signature", side.alias("side"), F.coalesce("n_old", zero).alias("n_old"), F.coalesce("n_new", zero).alias("n_new")
    )


def table_digest(df: DataFrame, key: str) -> DataFrame:
    """One row (n, digest): order-free content digest of a table, by partial aggregation.

    60 bits of each row's SHA-256 are added up as a decimal, which neither
    overflows nor lets equal rows cancel.
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(df.columns)]
    bits = F.conv(F.substring(F.sha2(F.concat_ws("|", *cells), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return df.agg(
        F.count("*").alias("n"),
        F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum(bits.cast("decimal(38,0)")).cast("string")), 256).alias("digest"),
        F.max(key).alias(f"max_{key}"),
    )


class Checkpoints:
    """Named table versions: parquet folders plus an append-only manifest.

    A delete or a restore is one more manifest row; the newest row per name
    counts. Nothing is rewritten in place.
    """

    SCHEMA = "name string, description string, created_at double, path string, rows long, digest string, state string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, row: tuple) -> None:
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").json(f"{self.root}/manifest")

    def manifest(self) -> DataFrame:
        """Newest entry per name, newest first, without deleted ones."""
        log = self.spark.read.schema(self.SCHEMA).json(f"{self.root}/manifest")
        best = log.groupBy("name").agg(F.max_by(F.struct(*log.columns[1:]), "created_at").alias("r"))
        return best.select("name", "r.*").filter("state = 'live'").orderBy(F.desc("created_at"))

    def create(self, name: str, table: DataFrame, key: str, now: float, description: str = "") -> None:
        path = f"{self.root}/data/{name}-{int(now * 1000)}"
        table.write.mode("errorifexists").parquet(path)
        stats = table_digest(self.spark.read.parquet(path), key).first()
        self._append((name, description, now, path, stats["n"], stats["digest"], "live"))

    def load(self, name: str) -> DataFrame:
        rows = self.manifest().filter(F.col("name") == name).limit(1).collect()
        if not rows:
            raise ValueError(f"no checkpoint named {name!r}")
        return self.spark.read.parquet(rows[0]["path"])

    def delete(self, name: str, now: float) -> None:
        self._append((name, "", now, "", 0, "", "deleted"))

    def diff(self, name_a: str, name_b: str, key: str, value: list[str]) -> DataFrame:
        return snapshot_diff(self.load(name_a), self.load(name_b), key, value)

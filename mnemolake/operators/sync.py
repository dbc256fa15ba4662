"""Delta sync of content-addressed stores: Merkle buckets, missing rows, conflict winners."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as hx
from .access import visible


def exportable(store: DataFrame, namespaces: list[str] | None = None, scope: str = "public") -> DataFrame:
    """Rows a peer may see: the scope lattice first, then any requested namespace."""
    out = store.filter(visible(scope)) if "scope" in store.columns else store
    if namespaces:
        out = out.filter(F.arrays_overlap("namespaces", F.array(*[F.lit(n) for n in namespaces])))
    return out


def merge_entries(store: DataFrame) -> DataFrame:
    """One row per hash: union of namespaces and supersedes, point-wise maximum clock.

    Sets and clocks are exploded and reduced before they are collected, so a
    hash that arrives a million times is combined map-side; what is collected
    is bounded by the number of namespaces, nodes and predecessors.
    """
    head = store.groupBy("hash").agg(
        F.min_by(F.struct("content", "memory_type", "origin_node"), F.struct("created_at", "origin_node", "content")).alias("h"),
        F.min("created_at").alias("created_at"),
    )

    def union(col: str) -> DataFrame:
        items = store.select("hash", F.explode(col).alias("x")).distinct()
        return items.groupBy("hash").agg(F.sort_array(F.collect_list("x")).alias(col))

    ticks = store.select("hash", F.explode("vclock").alias("node", "n")).groupBy("hash", "node").agg(F.max("n").alias("n"))
    clocks = ticks.groupBy("hash").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("node", "n")))).alias("vclock"))
    out = head.select("hash", "h.*", "created_at")
    for part in (union("namespaces"), union("supersedes"), clocks):
        out = out.join(part, "hash", "left")
    return out


#: Levels of every tree, two hex digits each: 16.8 million leaves, the same shape for every store, so that any two
#: trees can be compared. 10^11 hashes make leaves of about 6 000.
LEVELS = 3


def merkle_levels(hashes: DataFrame, depth: int = LEVELS) -> list[DataFrame]:
    """Tree levels from the leaves up: (prefix, digest, n).

    A leaf is the SHA-256 of its sorted hashes, an inner node that of its
    children's digests in order. Hashes are distinct and uniform, so no leaf
    outgrows a task; every inner node has at most 256 children.
    """
    leaves = (
        hashes.select("hash")
        .distinct()
        .groupBy(F.substring("hash", 1, 2 * depth).alias("prefix"))
        .agg(F.sha2(F.array_join(F.sort_array(F.collect_list("hash")), "\n"), 256).alias("digest"), F.count("*").alias("n"))
    )
    levels = [leaves]
    for level in range(depth - 1, 0, -1):
        up = levels[-1].groupBy(F.substring("prefix", 1, 2 * level).alias("prefix")).agg(
            F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("prefix", "digest"))), lambda s: s["digest"]), ""), 256).alias("digest"),
            F.sum("n").alias("n"),
        )
        levels.append(up)
    return levels


def merkle_buckets(hashes: DataFrame, depth: int = LEVELS) -> DataFrame:
    """(bucket, digest, n) for all 256 top buckets, empty ones included."""
    spark = hashes.sparkSession
    top = merkle_levels(hashes, depth)[-1]
    every = spark.range(256).select(F.col("id").cast("int").alias("bucket"))
    mine = top.select(F.conv("prefix", 16, 10).cast("int").alias("bucket"), "digest", "n")
    return every.join(mine, "bucket", "left").select(
        "bucket", F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("digest"), F.coalesce("n", F.lit(0)).alias("n")
    )


def merkle_root(buckets: DataFrame) -> DataFrame:
    """One row: hash of the 256 bucket digests in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("bucket", "digest"))), lambda s: s["digest"])
    return buckets.agg(F.sha2(F.array_join(ordered, ""), 256).alias("root"), F.sum("n").alias("n"))


def differing_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select("bucket", F.col("digest").alias("other"))
    return a.join(other, "bucket").filter("digest <> other").select("bucket")


def missing_rows(local: DataFrame, remote: DataFrame, depth: int = LEVELS) -> DataFrame:
    """Remote rows the local store lacks; only rows in differing buckets are compared."""
    apart = differing_buckets(merkle_buckets(local, depth), merkle_buckets(remote, depth))
    bucket = F.conv(F.substring("hash", 1, 2), 16, 10).cast("int")
    # At most 256 bucket numbers.
    far = remote.withColumn("bucket", bucket).join(F.broadcast(apart), "bucket", "left_semi")
    near = local.select("hash", bucket.alias("bucket")).join(F.broadcast(apart), "bucket", "left_semi")
    return far.join(near.select("hash"), "hash", "left_anti").drop("bucket")


def pull(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local store after taking the missing remote rows and merging clocks of shared ones."""
    return merge_entries(local.unionByName(remote))


def resolve(local: DataFrame, remote: DataFrame, key: str = "item_id") -> DataFrame:
    """Winner per key of two versions: clock dominance, else the later write, ties to the remote.

    Rows: (key, created_at, vclock, supersedes, payload).
    """
    a = local.select(key, F.struct("created_at", "vclock", "supersedes", "payload").alias("a"))
    b = remote.select(key, F.struct("created_at", "vclock", "supersedes", "payload").alias("b"))
    both = a.join(b, key, "full_outer")
    order = hx.clock_order(F.col("a.vclock"), F.col("b.vclock"))
    later = F.when(F.col("b.created_at") >= F.col("a.created_at"), "remote").otherwise("local")
    winner = (
        F.when(F.col("a").isNull(), "remote")
        .when(F.col("b").isNull(), "local")
        .when(order == "before", "remote")
        .when(order == "after", "local")
        .otherwise(later)
    )
    empty = F.create_map().cast("map<string,bigint>")
    none = F.array().cast("array<string>")
    return both.select(
        key,
        winner.alias("winner"),
        F.when(winner == "local", F.col("a.payload")).otherwise(F.col("b.payload")).alias("payload"),
        hx.clock_merge(F.coalesce("a.vclock", empty), F.coalesce("b.vclock", empty)).alias("vclock"),
        F.array_sort(F.array_union(F.coalesce("a.supersedes", none), F.coalesce("b.supersedes", none))).alias("supersedes"),
    )

"""Context packs: ranked rows, summaries and linked evidence under a character budget.

Everything packed for one query is bounded by its recall limit (at most 20
rows), so the ordered fold runs on small arrays inside one row per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import top_per_group

# Recall settings per policy.
POLICIES = {
    "balanced": {"limit": 10, "min_strength": 0.01, "temporal_boost": True, "depth": 2},
    "precise": {"limit": 4, "min_strength": 0.08, "temporal_boost": False, "depth": 1},
    "broad": {"limit": 20, "min_strength": 0.0, "temporal_boost": False, "depth": 3},
    "temporal": {"limit": 12, "min_strength": 0.01, "temporal_boost": True, "depth": 2},
}
YEAR = r"\b(?:19|20)\d{2}\b"


def _fold(items: Column, remaining: Column, cut_first: bool) -> Column:
    """struct(left, picked, done): take items in order while they fit.

    An item that does not fit is skipped; when nothing is picked yet and
    ``cut_first`` is set, it is cut to the room left and the walk ends.
    """
    start = F.struct(
        remaining.cast("int").alias("left"),
        F.array().cast("array<struct<id:bigint,text:string>>").alias("picked"),
        F.lit(False).alias("done"),
    )

    def step(acc: Column, it: Column) -> Column:
        cost = F.length(it["text"])
        live = ~acc["done"] & (acc["left"] > 0)
        fits = live & (cost <= acc["left"])
        first = live & ~fits & (F.size(acc["picked"]) == 0) & F.lit(cut_first)
        whole = F.struct(it["id"].alias("id"), it["text"].alias("text"))
        room = F.greatest(acc["left"] - 1, F.lit(1))
        short = F.struct(it["id"].alias("id"), F.concat(F.substring(it["text"], F.lit(1), room), F.lit("…")).alias("text"))
        return F.struct(
            F.when(fits, acc["left"] - cost - 2).when(first, 0).otherwise(acc["left"]).cast("int").alias("left"),
            F.when(fits, F.concat(acc["picked"], F.array(whole)))
            .when(first, F.concat(acc["picked"], F.array(short)))
            .otherwise(acc["picked"])
            .alias("picked"),
            (acc["done"] | first).alias("done"),
        )

    return F.aggregate(items, start, step)


def concept_summaries(records: DataFrame, bridge: DataFrame) -> DataFrame:
    """(query_id, summaries): up to eight lines, one per concept, busiest concept first.

    ``records`` (query_id, rank, memory_id, content) holds the recalled rows only.
    """
    text = F.trim("content")
    short = F.when(F.length(text) > 90, F.concat(F.substring(text, 1, 87), F.lit("..."))).otherwise(text)
    year = F.regexp_extract("content", YEAR, 0)
    dated = records.withColumn("year", year).withColumn(
        "snippet", F.when(F.col("year") != "", F.concat(short, F.lit(" ("), "year", F.lit(")"))).otherwise(short)
    )
    named = dated.join(bridge.select("memory_id", "concept"), "memory_id").select("query_id", "rank", "snippet", "concept")
    history = dated.filter("year <> ''").select("query_id", "rank", "snippet", F.lit("history").alias("concept"))
    buckets = named.union(history)
    known = buckets.select("query_id", "rank").distinct()
    loose = dated.join(known, ["query_id", "rank"], "left_anti").select(
        "query_id", "rank", "snippet", F.lit(None).cast("string").alias("concept")
    )
    lines = buckets.union(loose).groupBy("query_id", "concept").agg(
        F.count("*").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "snippet"))), lambda s: s["snippet"]).alias("snips"),
    )
    label = F.coalesce(F.initcap(F.replace("concept", F.lit("_"), F.lit(" "))), F.lit("Observed"))
    line = F.concat(label, F.lit(": "), F.array_join(F.slice(F.array_distinct("snips"), 1, 4), "; "))
    order = [F.col("concept").isNull(), F.desc("n"), F.asc("concept")]
    top = top_per_group(lines.withColumn("line", line), ["query_id"], order, 8)
    return top.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]).alias("summaries")
    )


def compile_context(
    ranked: DataFrame,
    memories: DataFrame,
    queries: DataFrame,
    bridge: DataFrame | None = None,
    edges: DataFrame | None = None,
    budget: int = 4000,
    policy: str = "balanced",
) -> DataFrame:
    """One row per query: selected summaries, memories and edges, and the compact text.

    ``ranked`` is the recall result (query_id, rank, memory_id, score).
    """
    hits = ranked.select("query_id", "rank", "memory_id", "score").join(
        memories.select("memory_id", "content", "created_at"), "memory_id"
    )
    snippet = F.concat(F.col("memory_id").cast("string"), F.lit(":"), F.substring("content", 1, 90))
    if policy == "temporal":
        key = F.struct(F.col("created_at").alias("o1"), F.col("rank").alias("o2"))
    else:
        key = F.struct((-F.round("score", 4)).alias("o1"), (-F.col("created_at")).alias("o2"), F.col("memory_id").alias("o3"))
    item = F.struct(key.alias("o"), F.col("memory_id").alias("id"), snippet.alias("text"))
    packs = queries.select("query_id", "query").join(
        hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"), F.count("*").alias("n_items")),
        "query_id", "left",
    )
    none = F.array().cast("array<string>")
    if bridge is None:
        packs = packs.withColumn("summaries", none)
    else:
        packs = packs.join(concept_summaries(hits, bridge), "query_id", "left").withColumn("summaries", F.coalesce("summaries", none))
    lines = F.transform("summaries", lambda s: F.struct(F.lit(0).cast("long").alias("id"), s.alias("text")))
    packs = packs.withColumn("s", _fold(lines, F.lit(budget), True))
    entries = F.transform(
        F.coalesce("items", F.array().cast("array<struct<o:struct<o1:double,o2:double,o3:bigint>,id:bigint,text:string>>"))
        if policy != "temporal"
        else F.col("items"),
        lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text")),
    )
    entries = F.coalesce(entries, F.array().cast("array<struct<id:bigint,text:string>>"))
    packs = packs.withColumn("m", _fold(entries, F.col("s.left"), True))
    if edges is None:
        packs = packs.withColumn("e", F.struct(F.col("m.left").alias("left"), F.array().cast("array<struct<id:bigint,text:string>>").alias("picked")))
    else:
        packs = packs.join(_linked(hits, edges), "query_id", "left")
        links = F.coalesce("links", F.array().cast("array<struct<id:bigint,text:string>>"))
        packs = packs.withColumn("e", _fold(links, F.col("m.left"), False))
    return _render(packs, budget)


def _linked(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, links): edges with both ends among a query's recalled rows."""
    src = hits.select("query_id", F.col("memory_id").alias("source_id"))
    dst = hits.select("query_id", F.col("memory_id").alias("target_id"))
    both = edges.select("source_id", "target_id", "edge_type").join(src, "source_id").join(dst, ["query_id", "target_id"])
    text = F.concat_ws("->", F.col("source_id").cast("string"), "edge_type", F.col("target_id").cast("string"))
    return both.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("source_id").alias("id"), text.alias("text")))).alias("links")
    )


def _render(packs: DataFrame, budget: int) -> DataFrame:
    def texts(c: str, k: int) -> Column:
        return F.array_join(F.transform(F.slice(F.col(c), 1, k), lambda p: p["text"]), " | ")

    parts = [
        F.concat(F.lit("Query: "), "query"),
        F.when(F.size("s.picked") > 0, F.concat(F.lit("Summaries: "), texts("s.picked", 3))),
        F.when(F.size("m.picked") > 0, F.concat(F.lit("Memories: "), texts("m.picked", 4))),
        F.when(F.size("e.picked") > 0, F.concat(F.lit("Evidence: "), texts("e.picked", 3))),
    ]
    compact = F.concat_ws(" | ", *parts)
    cut = F.when(F.length(compact) > budget, F.concat(F.substring(compact, 1, budget - 1), F.lit("…"))).otherwise(compact)
    ids = F.transform("m.picked", lambda p: p["id"])
    return packs.select(
        "query_id",
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.transform("s.picked", lambda p: p["text"]).alias("summaries"),
        ids.alias("memory_ids"),
        F.transform("e.picked", lambda p: p["text"]).alias("evidence"),
        F.col("e.left").alias("room_left"),
        cut.alias("compact"),
        F.length(cut).alias("budget_used"),
    )

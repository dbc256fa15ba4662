"""Concept graph and memory graph: co-occurrence, spreading, components, communities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, top_per_group


def cooccurrence(bridge: DataFrame) -> DataFrame:
    """(a, b, weight): memories that carry both concepts, a < b.

    Memories with the same concept set are counted together before pairs are
    formed, so a pattern repeated by a third of all rows expands once. A
    memory's own set is bounded by the concept vocabulary.
    """
    sets = (
        bridge.groupBy("memory_id")
        .agg(F.array_sort(F.collect_set("concept")).alias("cs"))
        .groupBy("cs")
        .agg(F.count("*").alias("n"))
        .filter(F.size("cs") > 1)
    )
    left = sets.select("n", "cs", F.posexplode("cs").alias("i", "a"))
    pairs = left.select("n", "a", F.explode(F.expr("slice(cs, i + 2, size(cs))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("weight"))


def both_ways(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(concept, neighbor, weight) in both directions."""
    fwd = pairs.select(F.col(a).alias("concept"), F.col(b).alias("neighbor"), "weight")
    return fwd.union(pairs.select(F.col(b).alias("concept"), F.col(a).alias("neighbor"), "weight"))


# Edge-type weights of the spread.
EDGE_TYPE_WEIGHTS = {"co_occurrence": 1.0, "factual": 1.5, "derived": 0.5}


def neighbors(bridge: DataFrame, triple_edges: DataFrame | None = None) -> DataFrame:
    """Co-occurrence neighbours plus optional triple edges (concept, neighbor, edge_type, weight)."""
    co = both_ways(cooccurrence(bridge)).withColumn("weight", F.col("weight").cast("double"))
    if triple_edges is None:
        return co
    scale = F.lit(1.0)
    for kind, w in EDGE_TYPE_WEIGHTS.items():
        scale = F.when(F.col("edge_type") == kind, w).otherwise(scale)
    extra = triple_edges.select("concept", "neighbor", (F.col("weight") * scale).alias("weight"))
    return co.unionByName(extra).groupBy("concept", "neighbor").agg(F.sum("weight").alias("weight"))


def multi_hop_spread(seeds: DataFrame, edges: DataFrame, max_hops: int = 3, decay: float = 0.5) -> DataFrame:
    """(query_id, concept, score): best product of decayed weights over at most ``max_hops``.

    ``seeds`` (query_id, concept), ``edges`` (concept, neighbor, weight). A
    value reached later can never beat the same node's earlier value further
    on, so the maximum over paths of each length is the whole result.
    """
    level = seeds.select("query_id", "concept").distinct().withColumn("score", F.lit(1.0))
    levels = [level]
    usable = edges.filter((F.col("concept") != F.col("neighbor")) & (F.col("weight") > 0))
    for _ in range(max_hops):
        level = (
            level.join(usable, "concept")
            .groupBy("query_id", F.col("neighbor").alias("concept"))
            .agg(F.max(F.col("score") * decay * F.col("weight")).alias("score"))
        )
        levels.append(level)
    merged = reduce(DataFrame.unionByName, levels)
    return merged.groupBy("query_id", "concept").agg(F.max("score").alias("score"))


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component): smallest node id reachable from each node.

    Alternating large-star / small-star contraction: O(log n) rounds, every
    round a min-aggregate with map-side combine, lineage cut by reliable
    checkpoints. Stops when a round changes no edge.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v")
    pairs = cut_lineage(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = cut_lineage(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
    seen = None
    while True:
        # Large star: hang every larger neighbour on the smallest of the neighbourhood.
        full = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = full.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = full.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # Small star: link the node and its smaller neighbours to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        pairs = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        mark = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        seen = mark
    root = pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(root, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


#: Folders over which labelled edges are spread by component.
EDGE_PARTS = 64


def _edge_part(component: str) -> Column:
    return F.pmod(F.xxhash64(component), F.lit(EDGE_PARTS)).cast("int")


def labelled_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, component, part): edges with their component, to be stored in one folder per ``part``."""
    of = labels.select(F.col("node").alias("a"), "component")
    return edges.select("a", "b").join(of, "a").withColumn("part", _edge_part("component"))


def update_components(labels: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(node, component) after edges were added and removed, as a full run over the new graph would give it.

    ``labels`` is the result before, ``edges`` the edges before as ``labelled_edges`` stores them, ``added`` and
    ``removed`` are (a, b). Only components that lose an edge can fall apart: their edges alone are read, by folder, and
    their nodes labelled anew; a node that has lost all edges leaves the graph. Added edges then join components: they are
    contracted to edges between labels, and only labels that such an edge touches change.
    """
    lost = removed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    at = labels.select(F.col("node").alias("a"), "component")
    torn = cut_lineage(lost.join(at, "a").select("component").distinct())
    parts = [r[0] for r in torn.select(_edge_part("component").alias("p")).distinct().collect()]  # at most EDGE_PARTS
    inner = edges.filter(F.col("part").isin(parts)).join(torn, "component", "left_semi")
    inner = inner.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(lost, ["a", "b"], "left_anti")
    again = connected_components(inner)
    now = cut_lineage(labels.join(torn, "component", "left_anti").select("node", "component").unionByName(again))
    ends = added.select("a", "b").filter("a <> b")
    ca = now.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    cb = now.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    # A node that is new is a component of its own.
    joined = ends.join(ca, "a", "left").join(cb, "b", "left").select(
        "a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")
    )
    joined = cut_lineage(joined)
    merged = connected_components(joined.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).withColumnRenamed("component", "low")
    new = joined.select(F.col("a").alias("node")).union(joined.select("b")).distinct().join(now, "node", "left_anti")
    nodes = now.unionByName(new.select("node", F.col("node").alias("component")))
    return nodes.join(merged.withColumnRenamed("node", "component"), "component", "left").select(
        "node", F.coalesce("low", "component").alias("component")
    )


def communities(pairs: DataFrame, min_size: int = 3, hubs: int = 3) -> DataFrame:
    """Component summaries: (component, size, total_weight, density, hub_concepts, label)."""
    comp = connected_components(pairs)
    sized = comp.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") >= min_size)
    inside = pairs.join(comp.withColumnRenamed("node", "a"), "a")
    weight = inside.groupBy("component").agg(F.sum("weight").alias("total_weight"))
    degree = (
        both_ways(pairs)
        .groupBy("concept")
        .agg(F.sum("weight").alias("degree"))
        .join(comp.withColumnRenamed("node", "concept"), "concept")
    )
    top = top_per_group(degree, ["component"], [F.desc("degree"), F.asc("concept")], hubs)
    # At most ``hubs`` rows per component are collected.
    named = top.groupBy("component").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "concept"))), lambda s: s["concept"]).alias("hub_concepts")
    )
    possible = F.col("size") * (F.col("size") - 1) / 2
    pretty = F.transform(
        F.slice("hub_concepts", 1, 2), lambda c: F.initcap(F.replace(c.cast("string"), F.lit("_"), F.lit(" ")))
    )
    return (
        sized.join(weight, "component")
        .join(named, "component")
        .withColumn("density", F.round(F.least(F.lit(1.0), F.col("total_weight") / possible), 6))
        .withColumn("label", F.array_join(pretty, " & "))
    )


def modularity(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: Newman modularity of a partition (node, component) of weighted pairs."""
    p = parts.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    q = parts.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    labelled = pairs.join(p, "a").join(q, "b")
    inner = labelled.filter("ca = cb").groupBy(F.col("ca").alias("component")).agg(F.sum("weight").alias("w_in"))
    degree = (
        both_ways(pairs)
        .join(parts.withColumnRenamed("node", "concept"), "concept")
        .groupBy("component")
        .agg(F.sum("weight").alias("deg"))
    )
    total = pairs.agg(F.sum("weight")).scalar()
    term = F.coalesce("w_in", F.lit(0)) / total - F.pow(F.col("deg") / (2 * total), 2)
    return degree.join(inner, "component", "left").agg(F.round(F.sum(term), 6).alias("modularity"))


def bfs_slice(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (query_id, memory_id, level) and edges reached from seed memories.

    Each level is one join of the frontier with the edge list; an edge keeps
    the level at which it was first crossed.
    """
    e = edges.select("source_id", "target_id", "edge_type", "weight").filter("source_id <> target_id")
    hop = e.select(F.col("source_id").alias("memory_id"), F.col("target_id").alias("to_id"), "*").union(
        e.select(F.col("target_id").alias("memory_id"), F.col("source_id").alias("to_id"), "*")
    )
    frontier = seeds.select("query_id", "memory_id").distinct()
    seen = frontier.withColumn("level", F.lit(0))
    crossed = None
    for level in range(1, depth + 1):
        step = frontier.join(hop, "memory_id").withColumn("level", F.lit(level))
        part = step.select("query_id", "source_id", "target_id", "edge_type", "weight", "level")
        crossed = part if crossed is None else crossed.unionByName(part)
        reached = step.select("query_id", F.col("to_id").alias("memory_id")).distinct()
        frontier = reached.join(seen, ["query_id", "memory_id"], "left_anti")
        seen = seen.unionByName(frontier.withColumn("level", F.lit(level)))
    keys = ["query_id", "source_id", "target_id", "edge_type"]
    return seen, crossed.groupBy(*keys).agg(F.min("level").alias("level"), F.max("weight").alias("weight"))


def neighbourhood_counts(bridge: DataFrame, seeds: DataFrame) -> DataFrame:
    """(concept, hop1, hop2) of the given concepts: distinct concepts within one and within two co-occurrence hops.

    Only what the seeds (concept) reach is joined, never all pairs of the graph.
    """
    adj = both_ways(cooccurrence(bridge)).select("concept", "neighbor")
    own = adj.join(seeds.select("concept").distinct(), "concept", "left_semi")
    hop1 = own.groupBy("concept").agg(F.count("*").alias("hop1"))
    step = own.withColumnRenamed("neighbor", "via").join(
        adj.select(F.col("concept").alias("via"), F.col("neighbor").alias("far")), "via"
    )
    reach = step.filter(F.col("concept") != F.col("far")).select("concept", "far").distinct()
    reach = reach.union(own).distinct()
    return hop1.join(reach.groupBy("concept").agg(F.count("*").alias("hop2")), "concept")


def chain_versions(edges: DataFrame) -> DataFrame:
    """(memory_id, chain_id, version, current) of supersedes chains.

    ``edges``: (source_id supersedes target_id), at most one per side. Pointer
    doubling: each round halves the distance to the oldest row, so a chain of
    length n takes log2(n) joins. Edges that form a cycle have no oldest row
    and raise an error.
    """
    link = edges.filter(F.col("edge_type") == "supersedes").select(
        F.col("source_id").alias("memory_id"), F.col("target_id").alias("prev")
    )
    newest = link.select("memory_id").join(link.select(F.col("prev").alias("memory_id")), "memory_id", "left_anti")
    ids = link.select("memory_id").union(link.select("prev")).distinct()
    state = cut_lineage(
        ids.join(link, "memory_id", "left").withColumn("steps", F.when(F.col("prev").isNotNull(), 1).otherwise(0).cast("long"))
    )
    for _ in range(ids.count().bit_length() + 1):
        far = state.select(F.col("memory_id").alias("prev"), F.col("prev").alias("next"), F.col("steps").alias("more"))
        state = cut_lineage(
            state.join(far, "prev", "left").select(
                "memory_id",
                F.coalesce("next", "prev").alias("prev"),
                (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            )
        )
        if state.join(link.select(F.col("memory_id").alias("prev")), "prev", "left_semi").isEmpty():
            break
    else:
        raise ValueError("the supersedes edges form a cycle")
    chain = state.select(
        "memory_id", F.coalesce("prev", "memory_id").alias("chain_id"), (F.col("steps") + 1).alias("version")
    )
    marks = newest.withColumn("current", F.lit(True))
    return chain.join(marks, "memory_id", "left").withColumn("current", F.coalesce("current", F.lit(False)))

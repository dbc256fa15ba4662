"""Ranked retrieval: BM25, concept IDF, blended recall, dual-path recall.

All operators take a *batch* of queries (query_id, query) and rank every
query in one job. Everything after the candidate cut holds at most
``10 x limit`` rows per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions import text as tx
from ..functions.timeparse import temporal_mode
from ..session import cut_lineage, save, top_per_group
from . import temporal as tm
from .index import corpus_stats, index_stats, lengths, read_postings, term_sets, tokenized


# Vectors of the query batch that are compared in one pass over the items.
PROBE_BLOCK = 512
#: Weights of a query batch that go to every task, so that rows are scored where they lie.
WEIGHT_ROWS = 100_000


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): stop words out, repeats kept as a weight."""
    return (
        queries.select("query_id", F.explode(tx.query_tokens(F.col("query"))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def _hits(tok: DataFrame, terms: DataFrame) -> DataFrame:
    """(memory_id, term, tf, dl) for the queried terms only.

    The distinct query terms filter the exploded tokens first (broadcast by
    Spark while under the auto-broadcast size); a row's tokens sit in one
    partition, so the map-side combine leaves one row per hit to shuffle.
    """
    return (
        tok.select("memory_id", "dl", F.explode_outer("words").alias("term"))
        .join(terms.select("term").distinct(), "term", "left_semi")
        .groupBy("memory_id", "term")
        .agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    )


def bm25(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, memory_id, score) for every memory that shares a term."""
    stats = corpus_stats(lengths(memories))
    terms = query_terms(queries)
    hits = _hits(tokenized(memories), terms)
    return _scored(hits, terms, stats.select("n_docs").scalar(), stats.select("avg_len").scalar())


def bm25_from_index(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """``bm25`` over a stored index: reads the buckets of the queried terms, and no text."""
    stats = index_stats(spark, path)
    terms = query_terms(queries)
    hits = read_postings(spark, path, terms)
    return _scored(hits, terms, stats.select("n_docs").scalar(), stats.select("avg_len").scalar())


def _scored(hits: DataFrame, terms: DataFrame, n_docs: Column, avg_len: Column) -> DataFrame:
    """(query_id, memory_id, score). Hits are dealt by row: a common term is no single task's, and a row's scores leave its task summed."""
    # The count reads tf and dl, so that it keeps the same columns as the join
    # below and both run on one shuffle of the hits.
    present = F.count_if((F.col("tf") > 0) & (F.col("dl") > 0))
    hits = hits.repartition("memory_id")
    idf = (
        hits.groupBy("term")
        .agg(present.alias("df"))
        .select("term", sc.bm25_idf(n_docs, F.col("df")).alias("idf"))
    )
    weighted = terms.join(idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    return (
        hits.join(_to_all(weighted, terms), "term")
        .groupBy("query_id", "memory_id")
        .agg(F.sum(F.col("w") * sc.bm25_tf(F.col("tf"), F.col("dl"), avg_len)).alias("score"))
        .filter(F.col("score") > 0)
    )


def _to_all(weights: DataFrame, source: DataFrame) -> DataFrame:
    """``weights``, broadcast where ``source``, which has a row for each of its rows at least, is under the bound."""
    return F.broadcast(weights) if source.limit(WEIGHT_ROWS + 1).count() <= WEIGHT_ROWS else weights


def bm25_top(memories: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    scored = bm25(memories, queries).withColumn("score", F.round("score", 6))
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.asc("memory_id")], limit)


def concept_idf(bridge: DataFrame, query_concepts: DataFrame, total: Column, limit: int | None = None) -> DataFrame:
    """(query_id, memory_id, score): sum of ln(total / df) over shared concepts, positive only.

    The bridge is dealt by memory, so that a frequent concept is no single task's and scores are summed where they arise.
    With ``limit``, memories that cannot be among the ``limit`` best of any query are left out before they meet the queries.
    """
    rows = bridge.select("memory_id", "concept").repartition("memory_id")
    if limit is not None:
        rows = save(rows, "bridge")
    df = rows.groupBy("concept").agg(F.count("*").alias("df"))
    weights = query_concepts.join(df, "concept").select(
        "query_id", "concept", F.log(total / F.col("df")).alias("idf")
    )
    weights = _to_all(weights if limit is None else save(weights, "weights"), query_concepts)
    if limit is not None:
        rows = _promising(rows, weights, limit)
    return _shared_weight(rows, weights)


def _shared_weight(rows: DataFrame, weights: DataFrame) -> DataFrame:
    met = rows.join(weights, "concept").groupBy("query_id", "memory_id")
    return met.agg(F.sum("idf").alias("score")).filter(F.col("score") > 0)


def _promising(rows: DataFrame, weights: DataFrame, limit: int) -> DataFrame:
    """The rows of the saved bridge whose memories may be among a query's ``limit`` best.

    All that a memory's concepts weigh for any query bounds its score for each query. The memories with the highest bounds
    are scored; what a query's ``limit``-th best of them has, every other one must reach, up to a margin for rounding. Where
    a query has fewer, no memory is left out.
    """
    most = weights.groupBy("concept").agg(F.greatest(F.max("idf"), F.lit(0.0)).alias("most"))
    bounds = save(rows.join(F.broadcast(most) if weights.count() <= WEIGHT_ROWS else most, "concept").groupBy("memory_id").agg(F.sum("most").alias("bound")), "bounds")

    def of(chosen: DataFrame) -> DataFrame:
        keys = chosen.select(F.col("memory_id").alias("_id"))
        return rows.join(keys, F.col("memory_id").eqNullSafe(F.col("_id")), "left_semi")

    first = bounds.orderBy(F.desc("bound"), "memory_id").limit(100 * limit)
    best = _ranked(_shared_weight(of(first), weights), "score", limit).groupBy("query_id")
    floors = best.agg(F.count("*").alias("n"), F.min("score").alias("low")).filter(F.col("n") >= limit)
    every = weights.select("query_id").distinct().withColumnRenamed("query_id", "_query")
    floors = every.join(floors, F.col("_query").eqNullSafe(F.col("query_id")), "left")
    low = floors.agg(F.min(F.coalesce("low", F.lit(0.0))).alias("low")).first()["low"]  # one number
    return of(bounds.filter(F.col("bound") >= (low or 0.0) - 1e-5))


def concept_weight(n_tokens: Column) -> Column:
    """Extra concept weight for very short queries."""
    return F.when(n_tokens <= 1, 0.5).when(n_tokens <= 2, 0.3).when(n_tokens <= 4, 0.2).otherwise(0.0)


def vector_weight(n_tokens: Column) -> Column:
    return F.when(n_tokens <= 3, 0.4).when(n_tokens <= 6, 0.3).otherwise(0.2)


def _ranked(df: DataFrame, score: str, k: int) -> DataFrame:
    return top_per_group(df, ["query_id"], [F.desc(score), F.asc("memory_id")], k).drop("rank")


def recall(
    memories: DataFrame,
    queries: DataFrame,
    bridge: DataFrame,
    query_concepts: DataFrame,
    now: float,
    limit: int = 10,
    visible: Column | None = None,
    min_strength: float = 0.01,
    temporal_boost: bool = True,
    activations: DataFrame | None = None,
    edges: DataFrame | None = None,
    episodes: DataFrame | None = None,
    vectors: DataFrame | None = None,
    conflicted: DataFrame | None = None,
    exclude_conflicted: bool = False,
    graph_scores: DataFrame | None = None,
    temporal: str | None = None,
    fact_keys: DataFrame | None = None,
) -> DataFrame:
    """Blended ranking of a query batch, without side effects.

    * ``visible``: row filter (scope, type) over ``memories`` columns.
    * ``activations``: (concept, count, last_activated).
    * ``edges``: (source_id, target_id, edge_type, weight).
    * ``episodes``: (episode_id, memory_id).
    * ``vectors``: (query_id, memory_id, cosine), already top ``5 x limit``.
    * ``conflicted``: (memory_id); penalised, or dropped before the limit.
    * ``graph_scores``: (query_id, memory_id, score) replaces the lexical stage.
    * ``temporal``: all, latest, as_of:<moment>, during:<start>:<end>, a month or a moment; applied to the ``2 x limit`` best
      rows of a query before the limit. ``fact_keys`` (memory_id, key) tell which rows state the same fact.

    Reinforcement is a separate job: see ``lifecycle.access_delta``.
    """
    live = ~F.coalesce(F.col("consolidated"), F.lit(False))
    allowed = live if visible is None else live & visible
    rows = memories.filter(allowed).select(
        "memory_id", "strength", "access_count", "last_accessed", "created_at", "memory_level",
        tm.start_of(memories).alias("_start"), tm.end_of(memories).alias("_end"),
    )
    graph_mode = graph_scores is not None
    if graph_mode:
        scored = graph_scores
    else:
        scored = bm25(memories, queries)
    # What the caller may not see never takes a place among the candidates.
    lex = _ranked(scored.join(rows.select("memory_id"), "memory_id", "left_semi"), "score", limit * 10).join(rows, "memory_id")
    per_query = Window.partitionBy("query_id")
    lex = lex.withColumn("bm", F.col("score") / F.max("score").over(per_query)).drop("score")
    if vectors is not None and not graph_mode:
        # Where no word matches, the vectors alone make the candidates.
        alone = vectors.select("query_id", "memory_id").join(lex.select("query_id").distinct(), "query_id", "left_anti")
        lex = lex.unionByName(alone.join(rows, "memory_id").withColumn("bm", F.lit(0.0)))
    n_tokens = queries.select("query_id", F.size(tx.query_tokens(F.col("query"))).alias("n_tokens"))
    cand = lex.join(n_tokens, "query_id")

    if graph_mode:
        cand = cand.withColumn("cn", F.lit(0.0)).withColumn("emb", F.lit(0.0))
        lexical = F.col("bm")
    else:
        total = rows.agg(F.count("*").alias("n")).scalar()
        con = concept_idf(bridge, query_concepts, total)
        con = _ranked(con.join(rows.select("memory_id"), "memory_id", "left_semi"), "score", limit * 10)
        cand = (
            cand.join(con.withColumnRenamed("score", "con"), ["query_id", "memory_id"], "left")
            .withColumn("cn", F.coalesce(F.col("con") / F.max("con").over(per_query), F.lit(0.0)))
            .drop("con")
        )
        if vectors is None:
            cand = cand.withColumn("emb", F.lit(0.0))
            fused = F.col("bm")
        else:
            cand = cand.join(vectors.withColumnRenamed("cosine", "emb"), ["query_id", "memory_id"], "left")
            has = F.max(F.col("emb").isNotNull().cast("int")).over(per_query) == 1
            we = F.when(has, vector_weight(F.col("n_tokens"))).otherwise(F.lit(0.0))
            cand = cand.withColumn("we", we).withColumn("emb", F.coalesce("emb", F.lit(0.0)))
            fused = F.col("bm") * (1 - F.col("we")) + F.col("emb") * F.col("we")
        lexical = fused + F.col("cn") * concept_weight(F.col("n_tokens")) * 0.05

    cand = cand.withColumn("lexical", lexical).filter(F.col("lexical") > 0)
    eff = sc.effective_strength(F.col("strength"), F.col("access_count"), F.col("last_accessed"), now)
    cand = cand.filter(eff >= min_strength)

    if activations is None:
        cand = cand.withColumn("heat", F.lit(0.0))
    else:
        hot = activations.select(
            "concept", sc.activation(F.col("count"), F.col("last_activated"), now).alias("a")
        )
        mine = (
            bridge.join(cand.select("memory_id").distinct(), "memory_id", "left_semi")
            .join(hot, "concept", "left")
            .groupBy("memory_id")
            .agg(F.avg(F.coalesce("a", F.lit(0.0))).alias("heat"))
        )
        cand = cand.join(mine, "memory_id", "left").withColumn("heat", F.coalesce("heat", F.lit(0.0)))

    cand = cand.withColumn("temporal", sc.recency(F.col("last_accessed"), now))
    provisional = 0.30 * F.col("lexical") + 0.25 * F.col("cn") + 0.20 * F.col("temporal") + 0.15 * F.col("heat")
    cand = cand.withColumn("score", F.round(provisional, 9))
    order = [F.desc("score"), F.asc("memory_id")]
    cand = top_per_group(cand, ["query_id"], order, limit * 2, "place")

    if episodes is None:
        cand = cand.withColumn("episode_id", F.lit(None).cast("long"))
    else:
        cand = cand.join(episodes, "memory_id", "left")
    by_place = Window.partitionBy("query_id").orderBy("place")
    whole = by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    anchor = F.first("episode_id").over(whole)
    same = F.coalesce((F.col("episode_id") == anchor).cast("double"), F.lit(0.0))
    cand = cand.withColumn("episode", same).withColumn("score", F.col("score") + 0.10 * F.col("episode"))

    top = F.col("place") <= limit
    boost = F.lit(1.0)
    if episodes is not None:
        mates = F.sum(top.cast("int")).over(Window.partitionBy("query_id", "episode_id")) - top.cast("int")
        boost = F.when(F.col("episode_id").isNotNull(), F.pow(F.lit(1.05), mates)).otherwise(F.lit(1.0))
    cand = cand.withColumn("boost", boost)
    if temporal_boost:
        near = F.abs(F.col("created_at") - F.first("created_at").over(whole)) <= 3600
        cand = cand.withColumn("boost", F.col("boost") * F.when(near, 1.05).otherwise(1.0))
    if edges is not None:
        cand = _edge_boosts(cand, edges, limit)
    if conflicted is not None:
        marks = conflicted.select("memory_id").distinct().withColumn("in_conflict", F.lit(True))
        cand = cand.join(marks, "memory_id", "left")
        if exclude_conflicted:
            cand = cand.filter(F.col("in_conflict").isNull())
        else:
            cand = cand.withColumn("boost", F.col("boost") * F.when(F.col("in_conflict"), 0.2).otherwise(1.0))
    level = F.when(F.col("memory_level") == "pattern", 1.3).when(F.col("memory_level") == "profile", 1.5)
    final = F.col("score") * F.col("boost") * F.coalesce(level, F.lit(1.0))
    cand = cand.withColumn("score", F.round(final, 6))
    if temporal is not None:
        cand = tm.in_mode(cut_lineage(cand), temporal_mode(temporal, now), fact_keys, bridge)
    return top_per_group(cand, ["query_id"], order, limit).select(
        "query_id", "rank", "memory_id", "score", "lexical", "cn", "emb", "temporal", "heat", "episode"
    )


def _edge_boosts(cand: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Multiply in (1 + 0.1 w) per edge from a top row, and 0.1 when superseded in the set."""
    ids = cand.select("query_id", "memory_id", "place")
    src = ids.filter(F.col("place") <= limit).select("query_id", F.col("memory_id").alias("from_id"))
    both = edges.select(F.col("source_id").alias("from_id"), F.col("target_id").alias("memory_id"), "weight").union(
        edges.select(F.col("target_id").alias("from_id"), F.col("source_id").alias("memory_id"), "weight")
    )
    product = (
        src.join(both, "from_id")
        .groupBy("query_id", "memory_id")
        .agg(F.exp(F.sum(F.log(1 + 0.1 * F.col("weight")))).alias("edge_boost"))
    )
    newer = ids.select("query_id", F.col("memory_id").alias("source_id"))
    replaced = (
        edges.filter(F.col("edge_type") == "supersedes")
        .select("source_id", F.col("target_id").alias("memory_id"))
        .join(newer, "source_id")
        .select("query_id", "memory_id")
        .distinct()
        .withColumn("replaced", F.lit(True))
    )
    keys = ["query_id", "memory_id"]
    out = cand.join(product, keys, "left").join(replaced, keys, "left")
    factor = F.coalesce("edge_boost", F.lit(1.0)) * F.when(F.col("replaced"), 0.1).otherwise(1.0)
    return out.withColumn("boost", F.col("boost") * factor).drop("edge_boost", "replaced")


def rank_by_strength(memories: DataFrame, now: float, limit: int) -> DataFrame:
    """Ranking of an empty query: strongest live rows first."""
    eff = sc.effective_strength(F.col("strength"), F.col("access_count"), F.col("last_accessed"), now)
    return (
        memories.filter(~F.coalesce(F.col("consolidated"), F.lit(False)))
        .select("memory_id", F.round(eff, 6).alias("effective_strength"))
        .orderBy(F.desc("effective_strength"), "memory_id")
        .limit(limit)
    )


def dual_path(
    memories: DataFrame,
    queries: DataFrame,
    bridge: DataFrame,
    query_concepts: DataFrame,
    spread,
    limit: int = 10,
    lexical_weight: float = 0.6,
    graph_weight: float = 0.4,
) -> DataFrame:
    """Lexical-overlap path and concept path, each max-normalised and blended.

    ``spread`` maps seeds (query_id, concept) to (query_id, concept, score);
    see ``graph.multi_hop_spread``.
    """
    terms = queries.select(
        "query_id", F.explode(F.array_distinct(tx.graph_tokens(F.col("query")))).alias("term")
    )
    overlap = term_sets(memories).join(terms, "term").groupBy("query_id", "memory_id").agg(F.count("*").alias("overlap"))
    seeds = top_per_group(overlap, ["query_id"], [F.desc("overlap"), F.asc("memory_id")], max(1, limit * 2))
    found = seeds.select("query_id", "memory_id").join(bridge, "memory_id").select("query_id", "concept").distinct()
    # Every hop of the spread starts from these few rows: written once.
    seed_concepts = cut_lineage(found)

    def by_memory(heat: DataFrame) -> DataFrame:
        return (
            heat.join(bridge.select("memory_id", "concept"), "concept")
            .groupBy("query_id", "memory_id")
            .agg(F.sum("score").alias("s"))
        )

    heat1 = by_memory(spread(seed_concepts))
    lexical_hits = overlap.join(heat1, ["query_id", "memory_id"], "full").select(
        "query_id",
        "memory_id",
        # A lexical hit collects its concept heat twice, a concept-only hit once.
        (
            F.coalesce("overlap", F.lit(0)) + F.coalesce("s", F.lit(0.0)) * F.when(F.col("overlap") > 0, 2).otherwise(1)
        ).alias("p1"),
    )
    p2 = by_memory(spread(query_concepts)).withColumnRenamed("s", "p2")
    per_query = Window.partitionBy("query_id")
    max1 = lexical_hits.groupBy("query_id").agg(F.max("p1").alias("m1"))
    max2 = p2.groupBy("query_id").agg(F.max("p2").alias("m2"))
    both = lexical_hits.join(p2, ["query_id", "memory_id"], "full").join(max1, "query_id", "left").join(
        max2, "query_id", "left"
    )
    blended = lexical_weight * F.coalesce(F.col("p1") / F.col("m1"), F.lit(0.0)) + graph_weight * F.coalesce(
        F.col("p2") / F.col("m2"), F.lit(0.0)
    )
    scored = both.select("query_id", "memory_id", F.round(blended, 6).alias("score"))
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.asc("memory_id")], limit)


def vector_top(items: DataFrame, probes: DataFrame, limit: int) -> DataFrame:
    """(query_id, memory_id, cosine): best positive cosines per probe.

    ``items`` (memory_id, embedding); ``probes`` (query_id, vector) is the query
    batch, taken PROBE_BLOCK rows at a time. Each block is one matrix of a fixed
    number of rows that goes to every task, which multiplies it with a batch of
    items and passes on the best ``limit`` per probe, ties included. Vectors of
    different length never match.
    """
    import numpy as np
    import pandas as pd

    ids = items.schema["memory_id"].dataType.simpleString()
    keys = probes.schema["query_id"].dataType.simpleString()

    def compare(names: list, block: np.ndarray) -> DataFrame:
        def best(batches):
            for batch in batches:
                batch = batch[[v is not None and len(v) == block.shape[1] for v in batch["embedding"]]]
                if not len(batch):
                    continue
                rows = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
                norm = np.sqrt((rows * rows).sum(axis=1))
                batch, rows = batch[norm > 0], rows[norm > 0] / norm[norm > 0, None]
                if not len(batch):
                    continue
                cosine = np.round(rows @ block.T, 6)
                at = max(len(cosine) - limit, 0)
                floor = np.partition(cosine, at, axis=0)[at]
                item, probe = np.nonzero((cosine >= floor) & (cosine > 0))
                yield pd.DataFrame(
                    {"query_id": [names[p] for p in probe], "memory_id": batch["memory_id"].to_numpy()[item], "cosine": cosine[item, probe]}
                )

        return items.select("memory_id", "embedding").mapInPandas(best, f"query_id {keys}, memory_id {ids}, cosine double")

    scored = items.sparkSession.createDataFrame([], f"query_id {keys}, memory_id {ids}, cosine double")
    waiting: dict[int, list] = {}

    def flush(size: int) -> None:
        nonlocal scored
        names, rows = zip(*waiting.pop(size), strict=True)
        block = np.array(rows, dtype=np.float64)
        block /= np.sqrt((block * block).sum(axis=1))[:, None]
        scored = scored.unionByName(compare(list(names), block))

    for r in probes.select("query_id", "vector").toLocalIterator():
        if r.vector is not None and any(r.vector):
            waiting.setdefault(len(r.vector), []).append((r.query_id, r.vector))
            if len(waiting[len(r.vector)]) == PROBE_BLOCK:
                flush(len(r.vector))
    for size in list(waiting):
        flush(size)
    return top_per_group(scored, ["query_id"], [F.desc("cosine"), F.asc("memory_id")], limit)

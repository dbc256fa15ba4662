"""Point-in-time, interval and latest-fact queries over bitemporal rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, save, top_per_group
from .selection import LAST_LINKS

#: Rows of a key that one pass of ``latest_facts`` looks at, the newest ones.
NEWEST = 32
#: Sets that the first pass of ``latest_similar`` compares with one another, and by how much a pass is larger than the last.
FIRST_SETS = 8192
GROWTH = 4


def start_of(df: DataFrame) -> Column:
    cols = [F.col(c) for c in ("valid_from", "observed_at", "created_at") if c in df.columns]
    return F.coalesce(*cols)


def end_of(df: DataFrame) -> Column:
    if "valid_to" not in df.columns:
        return F.lit(float("inf"))
    return F.coalesce("valid_to", F.lit(float("inf")))


def during(df: DataFrame, start: float, end: float) -> DataFrame:
    """Rows whose validity overlaps the interval; bounds may come in either order."""
    lo, hi = min(start, end), max(start, end)
    s, e = start_of(df), end_of(df)
    return df.filter((s <= hi) & (e >= lo) & (e > lo) & (s < hi))


def in_month(df: DataFrame, start: float, next_month: float) -> DataFrame:
    """Month mode works on creation time, end exclusive."""
    return df.filter((F.col("created_at") >= start) & (F.col("created_at") < next_month))


def around(df: DataFrame, moment: float | Column, radius: float = 3600.0) -> DataFrame:
    """Rows created within ``radius`` seconds of a moment, ends included."""
    at = moment if isinstance(moment, Column) else F.lit(moment)
    return df.filter(F.col("created_at").between(at - radius, at + radius))


def latest_by_key(df: DataFrame, key: str) -> DataFrame:
    """Newest row per key when every row carries exactly one key.

    A max aggregate instead of a window: partial maxima are taken map-side, so
    a hot key costs one row per task.
    """
    cols = [F.col(c) for c in df.columns if c != key]
    best = df.withColumn("_start", start_of(df)).groupBy(key).agg(
        F.max_by(F.struct(*cols), F.struct("_start", "memory_id")).alias("r")
    )
    return best.select(key, "r.*")


def as_of(df: DataFrame, moment: float, key: str) -> DataFrame:
    """Newest row per key among those that started by ``moment``; ends are ignored."""
    return latest_by_key(df.filter(start_of(df) <= moment), key)


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(memory_id): what the sequential pass keeps of at most LAST_LINKS keys of one batch stream."""
    parts = list(frames)
    if not parts:
        return
    held = pd.concat(parts).sort_values(["start", "memory_id"], ascending=False)
    used: set = set()
    kept = []
    for memory, own in held.groupby("memory_id", sort=False)["key"]:
        if used.isdisjoint(own):
            used.update(own)
            kept.append(memory)
    yield pd.DataFrame({"memory_id": kept})


def _newest_first(open_: DataFrame, last: int) -> DataFrame:
    """(memory_id): the rows of ``open_`` (memory_id, key, start) that the sequential pass keeps.

    Each round keeps the rows that are newest on all their keys and drops those that collide with them. The newest open row
    always wins, so every round closes a row. At most ``last`` open keys are walked through by one task.
    """
    rank = F.struct(F.col("start"), F.col("memory_id"))
    kept = []
    while (n := open_.count()) > last:
        top = open_.groupBy("key").agg(F.max(rank).alias("top"))
        won = open_.join(top, "key").groupBy("memory_id").agg(F.bool_and(F.col("top")["memory_id"] == F.col("memory_id")).alias("won"))
        wins = cut_lineage(won.filter("won").select("memory_id"))
        kept.append(wins)
        used = open_.join(wins, "memory_id", "left_semi").select("key").distinct()
        losers = open_.join(used, "key", "left_semi").select("memory_id").distinct()
        open_ = cut_lineage(open_.join(losers, "memory_id", "left_anti"))
    if n or not kept:
        kept.append(open_.coalesce(1).mapInPandas(_walk, f"memory_id {open_.schema['memory_id'].dataType.simpleString()}"))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def latest_facts(rows: DataFrame, keys: DataFrame, newest: int = NEWEST, last: int = LAST_LINKS) -> DataFrame:
    """Greedy latest-first selection when rows carry several keys.

    ``rows`` (memory_id, start), ``keys`` (memory_id, key). Newest first, a row
    is kept unless it shares a key with a kept row. A pass settles the rows that
    are among the ``newest`` of all their keys. A key that a row of these is kept
    for has no use for older rows. Where all of a key's newest are dropped, what
    the pass says holds down to the newest row it left out for such a key, and
    the next pass goes on from there; so the result equals the sequential pass.
    """
    rank = F.struct(F.col("start"), F.col("memory_id"))
    # A memory given twice counts from its newer start.
    dated = rows.groupBy("memory_id").agg(F.max("start").alias("start"))
    open_ = save(keys.select("memory_id", "key").filter("key IS NOT NULL").distinct().join(dated, "memory_id"), "open")
    kept = None
    while True:
        order = [F.desc_nulls_last("start"), F.desc("memory_id")]
        hot = top_per_group(open_, ["key"], order, newest + 1, "place").filter(F.col("place") == newest + 1)
        hot = save(hot.select("key", rank.alias("first_out")), "hot")
        out = open_.join(hot, "key").filter(rank <= F.col("first_out")).select("memory_id").distinct()
        near = save(open_.join(out, "memory_id", "left_anti"), "near")
        wins = save(_newest_first(near, last), "wins")
        taken = near.join(wins, "memory_id", "left_semi")
        missed = hot.join(taken.select("key").distinct(), "key", "left_anti").agg(F.max("first_out").alias("first_out")).first()["first_out"]
        if missed is not None:
            bound = hot.filter(F.col("first_out.memory_id") == missed["memory_id"]).select("first_out").limit(1)  # one row
            taken = taken.join(F.broadcast(bound), rank > F.col("first_out")).drop("first_out")
            wins = save(taken.select("memory_id").distinct(), "wins")
        kept = wins if kept is None else kept.unionByName(wins)
        if missed is None:
            return rows.join(kept, "memory_id", "left_semi")
        # What is newer than the bound is settled, and so is what shares a key with a kept row.
        rest = open_.join(F.broadcast(bound), rank <= F.col("first_out")).drop("first_out")
        losers = rest.join(taken.select("key").distinct(), "key", "left_semi").select("memory_id").distinct()
        open_ = save(rest.join(losers, "memory_id", "left_anti"), "open")


def _kept_of(sets: DataFrame, threshold: float) -> DataFrame:
    """(rep, start, words) of ``sets`` that the sequential pass keeps, newest first."""
    from . import selection, similarity

    pairs = similarity.jaccard_pairs(sets.select("rep", "words"), threshold)
    at = sets.select("rep", "start")
    ends = pairs.join(at.toDF("a", "sa"), "a").join(at.toDF("b", "sb"), "b")
    a_first = F.struct("sa", "a") > F.struct("sb", "b")
    links = ends.select(
        F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("first"), F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("later")
    )
    return sets.join(selection.dropped_by_order(links).withColumnRenamed("id", "rep"), "rep", "left_anti")


def latest_similar(rows: DataFrame, concepts: DataFrame, threshold: float = 0.5, first: int = FIRST_SETS) -> DataFrame:
    """Newest first, a row is dropped if its concept set overlaps a kept one's by ``threshold`` or more (Jaccard).

    ``rows`` (memory_id, start), ``concepts`` (memory_id, concept). A row without concepts resembles no other and stays.
    Of equal sets only the newest row can stay, so sets are compared once each. A pass settles the newest open sets, about
    ``first`` of them and more in each later pass: similar ones are found by the exact similarity join and settled in rounds
    (``selection.dropped_by_order``). The older sets then meet the kept ones only, and those that resemble one go before
    they are compared with one another.
    """
    from . import similarity

    own = concepts.select("memory_id", F.lower("concept").alias("concept")).join(rows.select("memory_id"), "memory_id", "left_semi")
    # A row's own concepts: bounded by the text itself.
    sets = own.groupBy("memory_id").agg(F.sort_array(F.collect_set("concept")).alias("words"))
    newest = F.max_by("memory_id", F.struct("start", "memory_id"))
    classes = (
        sets.join(rows.select("memory_id", "start"), "memory_id")
        .withColumn("digest", F.sha2(F.to_json("words"), 256))
        .groupBy("digest")
        .agg(newest.alias("rep"), F.max("start").alias("start"), F.first("words").alias("words"))
    )
    open_ = save(classes.select("rep", "start", "words"), "classes")
    kept, size = None, first
    while True:
        n = open_.count()
        # What starts at the bound or later comes before all else, whatever the order of equal starts.
        bound = open_.approxQuantile("start", [1 - size / n], 1e-4) if n > size else []
        head = save(open_.filter(F.col("start") >= bound[0]), "head") if bound else open_
        stay = save(_kept_of(head, threshold), "stay")
        kept = stay.select("rep") if kept is None else kept.unionByName(stay.select("rep"))
        if not bound:
            break
        rest = open_.join(head.select("rep"), "rep", "left_anti")
        met = similarity.jaccard_matches(stay.select(F.col("rep").alias("id"), "words"), rest.select(F.col("rep").alias("id"), "words"), threshold)
        open_ = save(rest.join(met.select(F.col("b").alias("rep")).distinct(), "rep", "left_anti"), "classes")
        size *= GROWTH
    kept = kept.withColumnRenamed("rep", "memory_id")
    bare = rows.join(sets.select("memory_id"), "memory_id", "left_anti")
    return rows.join(kept, "memory_id", "left_semi").unionByName(bare)


def latest_by_facts_or_concepts(rows: DataFrame, fact_keys: DataFrame, concepts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Latest facts of a store: rows with fact keys (subject, predicate, head of object) by keys, the others by concepts.

    ``rows`` (memory_id, start), ``fact_keys`` (memory_id, key), ``concepts`` (memory_id, concept). The two groups do not
    compete with each other.
    """
    keyed = rows.join(fact_keys.select("memory_id").distinct(), "memory_id", "left_semi")
    plain = rows.join(fact_keys.select("memory_id").distinct(), "memory_id", "left_anti")
    return latest_facts(keyed, fact_keys).unionByName(latest_similar(plain, concepts, threshold))


def latest_ranked(ranked: DataFrame, fact_keys: DataFrame | None, concepts: DataFrame) -> DataFrame:
    """Latest facts within each query's short ranking; the other rows go.

    ``ranked`` (query_id, memory_id, _start and any other columns) holds few rows per query, as after a candidate cut, so
    the sequential pass is a fold over one array per query. Newest first (later id on ties), a row with fact keys goes if it
    shares one with a kept row; a row without goes if its concepts overlap those of a kept row by half or more (Jaccard);
    a row with neither stays. The two kinds don't compete.
    """
    ids = ranked.select("memory_id").distinct()

    def sets(rows: DataFrame | None, col: str) -> DataFrame:
        # Bounded by what one memory's text holds.
        own = rows.select("memory_id", F.col(col).alias("_x")).join(ids, "memory_id", "left_semi") if rows is not None else ids.select("memory_id", F.lit(None).cast("string").alias("_x"))
        return own.groupBy("memory_id").agg(F.collect_set("_x").alias(f"_{col}s"))

    none = F.array().cast("array<string>")
    held = ranked.select("query_id", "memory_id", "_start").join(sets(fact_keys, "key"), "memory_id", "left").join(sets(concepts, "concept"), "memory_id", "left")
    row = F.struct("_start", "memory_id", F.coalesce("_keys", none).alias("keys"), F.coalesce("_concepts", none).alias("concepts"))
    lists = held.groupBy("query_id").agg(F.sort_array(F.collect_list(row), asc=False).alias("rows"))
    first = F.struct(
        F.array().cast(f"array<{ranked.schema['memory_id'].dataType.simpleString()}>").alias("kept"),
        none.alias("keys"), F.array().cast("array<array<string>>").alias("seen"),
    )

    def step(acc: Column, r: Column) -> Column:
        keyed = F.size(r["keys"]) > 0
        alike = F.exists(acc["seen"], lambda s: F.size(F.array_intersect(s, r["concepts"])) / F.size(F.array_union(s, r["concepts"])) >= 0.5)
        keep = F.when(keyed, ~F.arrays_overlap(acc["keys"], r["keys"])).otherwise(~alike)
        marks = keep & ~keyed & (F.size(r["concepts"]) > 0)
        return F.struct(
            F.when(keep, F.concat(acc["kept"], F.array(r["memory_id"]))).otherwise(acc["kept"]).alias("kept"),
            F.when(keep & keyed, F.concat(acc["keys"], r["keys"])).otherwise(acc["keys"]).alias("keys"),
            F.when(marks, F.concat(acc["seen"], F.array(r["concepts"]))).otherwise(acc["seen"]).alias("seen"),
        )

    kept = lists.select("query_id", F.explode(F.aggregate("rows", first, step)["kept"]).alias("memory_id"))
    return ranked.join(kept, ["query_id", "memory_id"], "left_semi")


def in_mode(
    ranked: DataFrame, mode: tuple[str, float | None, float | None], fact_keys: DataFrame | None, concepts: DataFrame
) -> DataFrame:
    """A short ranking (query_id, memory_id, created_at, _start, _end, ...) under a mode of ``timeparse.temporal_mode``."""
    kind, t0, t1 = mode
    if kind == "as_of" and t0 is not None:
        return latest_ranked(ranked.filter(F.col("_start") <= t0), fact_keys, concepts)
    if kind == "latest":
        return latest_ranked(ranked, fact_keys, concepts)
    if kind == "during":
        low, high = min(t0, t1), max(t0, t1)
        return ranked.filter((F.col("_start") < high) & (F.col("_end") > low))
    if kind == "month":
        return ranked.filter((F.col("created_at") >= t0) & (F.col("created_at") < t1))
    return ranked


def ordered_chains(rows: DataFrame, key: str, time: str = "created_at", slice_seconds: float = 7 * 86400.0) -> DataFrame:
    """Chains of rows of one key, each superseding the one before it in (time, memory_id) order.

    (memory_id, key, time, chain_id, version, supersedes, superseded_by, current). Keys with a single row form no chain.
    Neighbours and versions are found per time slice, so that a hot key is no single task's work.
    """
    from . import splits

    base = rows.select("memory_id", key, time)
    first = base.groupBy(key).agg(F.min_by("memory_id", F.struct(time, "memory_id")).alias("chain_id"), F.count("*").alias("_n"))
    near = splits.with_neighbor(base, [key], time, "memory_id", ["memory_id"], slice_seconds=slice_seconds)
    both = splits.with_neighbor(near, [key], time, "memory_id", ["memory_id"], forward=True, slice_seconds=slice_seconds)
    placed = splits.with_position(both, [key], time, "memory_id", "version", slice_seconds)
    return placed.join(first.filter("_n > 1"), key).select(
        "memory_id", key, time, "chain_id", "version", F.col("prev_memory_id").alias("supersedes"),
        F.col("next_memory_id").alias("superseded_by"), F.col("next_memory_id").isNull().alias("current"),
    )


def as_of_chain(versions: DataFrame, moments: DataFrame, bin_seconds: float = 30 * 86400.0) -> DataFrame:
    """The version of its chain that held at each moment: the highest one created by then.

    ``versions`` (memory_id, chain_id, version, created_at), ``moments`` (chain_id, at and any other columns). Returns the
    moments with memory_id and version, null where the chain began later. Both sides meet in bins of time: a running
    maximum per (chain, bin), and one over the bins' maxima per chain. Nothing is joined by inequality, and a chain that
    holds a third of all rows is spread over its bins.
    """
    best = F.struct("version", "memory_id")
    bin_of = F.floor(F.col("_t") / bin_seconds)
    own = [c for c in moments.columns if c not in ("memory_id", "version")]
    old = versions.select("chain_id", F.col("created_at").alias("_t"), best.alias("_v")).withColumn("_bin", bin_of)
    asked = moments.select("chain_id", F.col("at").alias("_t"), F.struct(*own).alias("_m")).withColumn("_bin", bin_of)
    both = old.unionByName(asked, allowMissingColumns=True)
    # At one time, versions come before moments.
    inside = Window.partitionBy("chain_id", "_bin").orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("_here", F.max("_v").over(inside)).filter("_m IS NOT NULL")
    tops = both.groupBy("chain_id", "_bin").agg(F.max("_v").alias("_top"))
    earlier = Window.partitionBy("chain_id").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select("chain_id", "_bin", F.max("_top").over(earlier).alias("_before"))
    found = met.join(before, ["chain_id", "_bin"]).withColumn("_v", F.greatest("_here", "_before"))
    return found.select("_m.*", F.col("_v.memory_id").alias("memory_id"), F.col("_v.version").alias("version"))


def fact_history(matches: DataFrame, chains: DataFrame) -> DataFrame:
    """Whole chain of each query's best match, oldest first by version: (query_id, memory_id, version, current).

    ``matches`` (query_id, memory_id, rank) as ranked by any recall, ``chains`` (memory_id, chain_id, version, current). A
    best match outside all chains is a chain of itself.
    """
    best = matches.filter("rank = 1").select("query_id", "memory_id")
    found = best.join(chains.select("memory_id", "chain_id"), "memory_id", "left")
    alone = found.filter("chain_id IS NULL").select("query_id", "memory_id", F.lit(1).cast("long").alias("version"), F.lit(True).alias("current"))
    linked = found.filter("chain_id IS NOT NULL").select("query_id", "chain_id")
    rows = linked.join(chains.select("chain_id", "memory_id", "version", "current"), "chain_id")
    return rows.select("query_id", "memory_id", "version", "current").unionByName(alone)


def chain_timeline(chains: DataFrame, bridge: DataFrame | None = None, concept: str | None = None) -> DataFrame:
    """Changes of facts in time order: every row that supersedes or is superseded, optionally of one concept."""
    out = chains
    if concept is not None:
        of = bridge.filter(F.lower("concept") == concept.lower()).select("memory_id").distinct()
        out = out.join(of, "memory_id", "left_semi")
    return out.select(
        "memory_id", "supersedes", "superseded_by", F.concat(F.lit("chain-"), F.col("chain_id").cast("string")).alias("fact_chain_id"),
        F.col("created_at").alias("timestamp"),
    ).orderBy("timestamp", "memory_id")


def temporal_chain(memories: DataFrame, bridge: DataFrame, topics: list[str]) -> DataFrame:
    """Memories on any of the topics in order of their start."""
    wanted = bridge.filter(F.lower("concept").isin([t.lower() for t in topics])).select("memory_id").distinct()
    rows = memories.join(wanted, "memory_id", "left_semi")
    return rows.orderBy(start_of(rows), "memory_id")


def timeline(memories: DataFrame, start: float | None = None, end: float | None = None, topic: str | None = None) -> DataFrame:
    """Live rows in a closed range, optionally about a topic, oldest first."""
    out = memories
    if start is not None:
        out = out.filter(F.col("created_at") >= start)
    if end is not None:
        out = out.filter(F.col("created_at") <= end)
    if topic:
        out = out.filter(F.contains(F.lower("content"), F.lit(topic.lower())))
    return out.orderBy("created_at", "memory_id")

"""Import and merge of one store into another: duplicates, new ids, and every reference rewritten.

A store is a dict of frames:

    memories   memory_id, content, created_at, and any other columns
    edges      source_id, target_id, edge_type, weight
    concepts   memory_id, concept, category
    episodes   episode_id, name, started_at, ended_at
    members    episode_id, memory_id

Incoming rows are taken in id order. A row is a duplicate if its token set is similar to that of an existing row, or of
an earlier incoming row that was itself taken in; what the sequential pass would take in is found in rounds over the
links of a similarity join (``selection.dropped_by_order``). Equal token sets are decided once, as a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import save
from . import selection, similarity, splits

THRESHOLD = 0.85
#: Ids numbered by one task.
ID_SLICE = 1 << 16

Store = dict[str, DataFrame]


def _classes(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal token sets (rep, words as hashes) and members (memory_id, rep). Texts without tokens are one class."""
    words = memories.select("memory_id", tx.token_set(F.coalesce("content", F.lit(""))).alias("words"))
    sets = words.withColumn("digest", F.sha2(F.array_join("words", " "), 256)).withColumn("words", similarity.hashes(F.col("words")))
    sets = save(sets, "token_sets")
    reps, members = similarity.collapse_copies(sets)
    return save(reps.select("rep", "words"), "classes"), members


def _best(matches: DataFrame) -> DataFrame:
    """(rep, target, is_old, similarity): the most similar match; ties go to existing rows, then to the smallest id."""
    rank = F.struct("similarity", "is_old", (-F.col("target")).alias("neg"))
    return matches.groupBy("rep").agg(F.max_by(F.struct("target", "is_old", "similarity"), rank).alias("m")).select("rep", "m.*")


def match_incoming(existing: DataFrame, incoming: DataFrame, threshold: float = THRESHOLD, keep_all: bool = False) -> DataFrame:
    """(memory_id, rep, target, is_old, similarity) for every incoming row.

    ``target`` is the row it duplicates, existing (``is_old``) or taken in from ``incoming``; null for the rows that are
    taken in. Under ``keep_all`` every row is taken in, and ``target`` is its best match among existing and all earlier
    incoming rows.
    """
    olds, _ = _classes(existing)
    news, members = _classes(incoming)

    def ids(df: DataFrame) -> DataFrame:
        return df.filter(F.size("words") > 0).select(F.col("rep").alias("id"), "words")

    def empty(df: DataFrame) -> DataFrame:
        return df.filter(F.size("words") == 0).select("rep")

    match = [F.col("a").alias("rep"), F.col("b").alias("target"), F.lit(True).alias("is_old"), "similarity"]
    old = similarity.jaccard_matches(ids(news), ids(olds), threshold).select(*match)
    # Two texts without tokens are alike; each side has at most one class of them.
    both_empty = empty(news).select(F.lit(1).alias("k"), "rep").join(empty(olds).select(F.lit(1).alias("k"), F.col("rep").alias("target")), "k")
    old = save(old.unionByName(both_empty.select("rep", "target", F.lit(True).alias("is_old"), F.lit(1.0).alias("similarity"))), "matches")
    rest = news if keep_all else news.join(old.select("rep").distinct(), "rep", "left_anti")
    pairs = save(similarity.jaccard_pairs(rest.filter(F.size("words") > 0), threshold), "pairs")
    inner = pairs.select(F.col("b").alias("rep"), F.col("a").alias("target"), F.lit(False).alias("is_old"), "similarity")
    if not keep_all:
        gone = selection.dropped_by_order(pairs.select(F.col("a").alias("first"), F.col("b").alias("later")))
        inner = inner.join(gone.withColumnRenamed("id", "rep"), "rep", "left_semi").join(
            gone.withColumnRenamed("id", "target"), "target", "left_anti"
        )
    best = _best(old.unionByName(inner))
    rows = members.join(best, "rep", "left")
    # Later copies of a class: duplicates of its first row, or of what the first row duplicates.
    first = F.col("memory_id") == F.col("rep")
    copy = ~first & (F.col("target").isNull() | (F.lit(keep_all) & ~(F.col("is_old") & (F.col("similarity") == 1.0))))
    return rows.select(
        "memory_id",
        "rep",
        F.when(copy, F.col("rep")).otherwise(F.col("target")).alias("target"),
        F.when(copy, F.lit(False)).otherwise(F.col("is_old")).alias("is_old"),
        F.when(copy, F.lit(1.0)).otherwise(F.col("similarity")).alias("similarity"),
    )


def numbered(rows: DataFrame, key: str, after: int, name: str = "new_id") -> DataFrame:
    """Dense ids behind ``after`` in the order of ``key``; slices of the key are numbered side by side."""
    base = rows.withColumn("_all", F.lit(0))
    placed = splits.with_position(base, ["_all"], key, key, name, slice_seconds=float(ID_SLICE))
    return placed.withColumn(name, (F.col(name) + F.lit(after)).cast("long")).drop("_all")


def _largest(df: DataFrame, key: str) -> int:
    return df.agg(F.max(key)).first()[0] or 0


def id_map(existing: DataFrame, matched: DataFrame, keep_all: bool = False) -> DataFrame:
    """(memory_id, new_id, taken_in): the id that each incoming row has in the store from now on."""
    taken = matched if keep_all else matched.filter("target IS NULL")
    ids = numbered(taken.select("memory_id"), "memory_id", _largest(existing, "memory_id"))
    own = ids.select("memory_id", "new_id", F.lit(True).alias("taken_in"))
    if keep_all:
        return own
    dups = matched.filter("target IS NOT NULL").select("memory_id", "target", "is_old")
    old = dups.filter("is_old").select("memory_id", F.col("target").alias("new_id"))
    new = dups.filter("NOT is_old").join(ids.select(F.col("memory_id").alias("target"), "new_id"), "target")
    return own.unionByName(old.unionByName(new.select("memory_id", "new_id")).withColumn("taken_in", F.lit(False)))


def _mapped(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is mapped, with the new id in its place."""
    m = ids.select(F.col("memory_id").alias(column), F.col("new_id").alias("_new"))
    return df.join(m, column).drop(column).withColumnRenamed("_new", column)


def _references(existing: Store, incoming: Store, ids: DataFrame, by_name: bool) -> Store:
    """Edges, concepts, episodes and members of both stores under one set of ids."""
    edges = _mapped(_mapped(incoming["edges"], ids, "source_id"), ids, "target_id")
    concepts = existing["concepts"].unionByName(_mapped(incoming["concepts"], ids, "memory_id").select(*existing["concepts"].columns))
    eps = incoming["episodes"]
    if by_name:
        # An episode goes to the existing one of its name, otherwise to the first incoming one.
        named = existing["episodes"].filter("name <> ''").groupBy("name").agg(F.min("episode_id").alias("old_id"))
        firsts = eps.filter("name <> ''").groupBy("name").agg(F.min("episode_id").alias("first_id"))
        placed = eps.join(named, "name", "left").join(firsts, "name", "left").select(
            "episode_id", "old_id", F.coalesce("first_id", "episode_id").alias("first_id")
        )
    else:
        placed = eps.select("episode_id", F.lit(None).cast("long").alias("old_id"), F.col("episode_id").alias("first_id"))
    fresh = placed.filter("old_id IS NULL AND episode_id = first_id").select("episode_id")
    new_ids = save(numbered(fresh, "episode_id", _largest(existing["episodes"], "episode_id"), "new_ep"), "episode_ids")
    ep_map = placed.join(new_ids.select(F.col("episode_id").alias("first_id"), "new_ep"), "first_id", "left").select(
        "episode_id", F.coalesce("old_id", "new_ep").alias("new_ep")
    )
    added = eps.join(new_ids, "episode_id").drop("episode_id").withColumnRenamed("new_ep", "episode_id")
    members = _mapped(incoming["members"], ids, "memory_id").join(ep_map, "episode_id").drop("episode_id")
    members = members.withColumnRenamed("new_ep", "episode_id").select(*existing["members"].columns)
    return {
        "edges": existing["edges"].unionByName(edges.select(*existing["edges"].columns)),
        "concepts": concepts.dropDuplicates(["memory_id", "concept"]),
        "episodes": existing["episodes"].unionByName(added.select(*existing["episodes"].columns)),
        "members": existing["members"].unionByName(members).distinct(),
    }


def _inserted(existing: DataFrame, incoming: DataFrame, ids: DataFrame) -> DataFrame:
    rows = incoming.join(ids.filter("taken_in").select("memory_id", "new_id"), "memory_id")
    return rows.drop("memory_id").withColumnRenamed("new_id", "memory_id").select(*existing.columns)


def import_store(existing: Store, incoming: Store, threshold: float = THRESHOLD) -> tuple[Store, DataFrame]:
    """``existing`` with all of ``incoming`` that it does not hold yet, and the id map (memory_id, new_id, taken_in).

    Duplicates are not stored; what refers to them refers to the row they duplicate. Edges with an end that is in
    neither store are left out.
    """
    matched = save(match_incoming(existing["memories"], incoming["memories"], threshold), "matched")
    ids = save(id_map(existing["memories"], matched), "id_map")
    memories = existing["memories"].unionByName(_inserted(existing["memories"], incoming["memories"], ids))
    return {"memories": memories, **_references(existing, incoming, ids, by_name=False)}, ids


def merge_store(
    existing: Store, incoming: Store, keep_both: bool = False, source: str = "unknown", threshold: float = THRESHOLD
) -> tuple[Store, DataFrame]:
    """``incoming`` merged into ``existing``, and the id map.

    Newer wins: a duplicate that is newer than the row it duplicates replaces that row's content, and its strength and
    last access count if they are higher; of several, the newest one's content stays (ties: smallest id). Keep both:
    every row is stored, and ``duplicate_of`` names its best match. Added rows carry ``merged_from``. Episodes of one
    name become one.
    """
    old, new = existing["memories"], incoming["memories"]
    matched = save(match_incoming(old, new, threshold, keep_both), "matched")
    ids = save(id_map(old, matched, keep_both), "id_map")
    cols = old.columns
    extra = {"merged_from": F.lit(None).cast("string"), "duplicate_of": F.lit(None).cast("long")}
    kept = old.withColumns({c: v for c, v in extra.items() if c not in cols})
    added = _inserted(old, new, ids).withColumn("merged_from", F.lit(source))
    if keep_both:
        pointed = matched.filter("target IS NOT NULL").select("memory_id", "target", "is_old")
        ends = pointed.join(ids.select(F.col("memory_id").alias("target"), F.col("new_id").alias("t")), "target", "left")
        found = ends.select("memory_id", F.when(F.col("is_old"), F.col("target")).otherwise(F.col("t")).alias("duplicate_of"))
        found = _mapped(found, ids, "memory_id")
        added = added.join(found, "memory_id", "left")
        memories = kept.unionByName(added.select(*kept.columns))
    else:
        base = kept.unionByName(added.withColumn("duplicate_of", F.lit(None).cast("long")).select(*kept.columns))
        dups = _mapped(new.withColumn("_from", F.col("memory_id")), ids.filter("NOT taken_in"), "memory_id")
        memories = _newest_wins(base, dups)
    return {"memories": memories, **_references(existing, incoming, ids, by_name=True)}, ids


def _newest_wins(base: DataFrame, dups: DataFrame) -> DataFrame:
    """Base rows with the content of their newest duplicate, where that is newer than they are."""
    at = base.select("memory_id", F.col("created_at").alias("_at"))
    newer = dups.join(at, "memory_id").filter("created_at > _at")
    texts = [c for c in ("content", "metadata") if c in base.columns]
    tops = [c for c in ("strength", "last_accessed") if c in base.columns]
    rank = F.struct("created_at", (-F.col("_from")).alias("neg"))
    wins = newer.groupBy("memory_id").agg(
        F.max_by(F.struct(*texts), rank).alias("_text"), *[F.max(c).alias(f"_{c}") for c in tops], F.lit(True).alias("_won")
    )
    joined = base.join(wins, "memory_id", "left")

    def cell(c: str) -> Column:
        if c in texts:
            return F.when(F.col("_won"), F.col(f"_text.{c}")).otherwise(F.col(c)).alias(c)
        return F.greatest(c, f"_{c}").alias(c) if c in tops else F.col(c)

    return joined.select(*[cell(c) for c in base.columns])

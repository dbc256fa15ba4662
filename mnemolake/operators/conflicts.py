"""Contradictions without enumerating every pair of a group.

Whether two statements conflict depends only on small values (an attribute's
number, a member of an exclusive set, a negated signature). Statements are
therefore reduced to value classes first; conflicts are found between classes,
and a memory's own worst conflict follows from its class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import facts as fx
from .similarity import jaccard_matches

# Kinds in order of priority when one dispute is shown.
KIND_PRIORITY = ["mutual_exclusion", "numeric_range", "polarity", "temporal_conflict"]


def numeric_statements(memories: DataFrame) -> DataFrame:
    """(memory_id, attribute, value) from text."""
    rows = memories.select("memory_id", F.explode_outer(fx.numeric_facts(F.col("content"))).alias("attribute", "value"))
    return rows.filter(F.col("attribute").isNotNull())


def numeric_groups(statements: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and attribute: value range, distinct values and the widest conflict.

    For non-negative values the conflict of a fixed value grows with distance
    on either side, so the extremes decide and one aggregate suffices.
    """
    g = statements.groupBy(*keys, "attribute").agg(
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.countDistinct("value").alias("n_values"),
        F.count("*").alias("n_statements"),
    )
    conf = fx.numeric_conflict(F.col("low"), F.col("high"))
    return g.filter("n_values > 1").withColumn("confidence", F.round(conf, 6))


def numeric_disputes(statements: DataFrame, keys: list[str]) -> DataFrame:
    """(memory_id, keys, attribute, value, rival, confidence): each statement's worst rival value."""
    groups = numeric_groups(statements, keys).select(*keys, "attribute", "low", "high")
    joined = statements.join(groups, [*keys, "attribute"])
    to_low = fx.numeric_conflict(F.col("value"), F.col("low"))
    to_high = fx.numeric_conflict(F.col("value"), F.col("high"))
    low_wins = (F.col("value") != F.col("low")) & ((F.col("value") == F.col("high")) | (to_low >= to_high))
    return joined.select(
        "memory_id",
        *keys,
        "attribute",
        "value",
        F.when(low_wins, F.col("low")).otherwise(F.col("high")).alias("rival"),
        F.round(F.when(low_wins, to_low).otherwise(to_high), 6).alias("confidence"),
    )


def exclusive_statements(memories: DataFrame, sets: list[list[str]] | None = None) -> DataFrame:
    """(memory_id, set_id, members): mentioned members of each exclusive set."""
    sets = sets or fx.EXCLUSIVE_SETS
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("set_id"), fx.exclusive_values(F.col("content"), s).alias("members"))
            for i, s in enumerate(sets)
        ]
    )
    return memories.select("memory_id", F.inline(rows)).filter(F.size("members") > 0)


def exclusive_classes(statements: DataFrame, keys: list[str]) -> DataFrame:
    """Conflicting member classes per key: (keys, set_id, members_a, members_b, n_a, n_b).

    At most 2^k - 1 classes exist per set of k values, whatever the row count.
    """
    classes = statements.groupBy(*keys, "set_id", "members").agg(
        F.count("*").alias("n"), F.min("memory_id").alias("first_id")
    )
    a = classes.select(
        *keys, "set_id", F.col("members").alias("members_a"), F.col("n").alias("n_a"), F.col("first_id").alias("first_a")
    )
    b = classes.select(
        *keys, "set_id", F.col("members").alias("members_b"), F.col("n").alias("n_b"), F.col("first_id").alias("first_b")
    )
    joined = a.join(b, [*keys, "set_id"]).filter(F.col("members_a") < F.col("members_b"))
    return joined.withColumn("confidence", F.lit(0.95))


def polarity_classes(memories: DataFrame) -> DataFrame:
    """(signature, negated, n, first_id, words): statements reduced to their signatures."""
    sig = fx.polarity_signature(F.col("content"))
    rows = memories.select("memory_id", sig.alias("s")).select("memory_id", "s.signature", "s.negated")
    rows = rows.filter(F.size("signature") > 0)
    digest = F.sha2(F.array_join("signature", " "), 256)
    return rows.groupBy(digest.alias("digest"), "negated").agg(
        F.count("*").alias("n"), F.min("memory_id").alias("first_id"), F.first("signature").alias("words")
    )


def polarity_conflicts(memories: DataFrame) -> DataFrame:
    """Negated and plain statement classes with signature overlap >= 0.5.

    An exact similarity join of the two sides on distinct signatures.
    """
    classes = polarity_classes(memories)
    plain = classes.filter("NOT negated")
    negative = classes.filter("negated")
    found = jaccard_matches(
        plain.select(F.col("first_id").alias("id"), "words"), negative.select(F.col("first_id").alias("id"), "words"), 0.5
    )
    na = plain.select(F.col("first_id").alias("a"), F.col("n").alias("n_a"))
    nb = negative.select(F.col("first_id").alias("b"), F.col("n").alias("n_b"))
    return (
        found.join(na, "a")
        .join(nb, "b")
        .withColumn("confidence", F.round(fx.polarity_conflict(F.col("similarity")), 6))
        .withColumn("similarity", F.round("similarity", 6))
    )


def check_new(new: DataFrame, existing: DataFrame, new_bridge: DataFrame, bridge: DataFrame) -> DataFrame:
    """Conflicts of a newly written batch with existing rows that share a concept.

    Returns (new_id, kind, n_existing, confidence): per new row and kind the
    number of conflicting existing rows and the strongest conflict, by value
    class, so a concept shared by a third of the store is never paired row by row.
    """
    nb = new_bridge.select("memory_id", "concept")
    eb = bridge.select("memory_id", "concept")
    num_new = numeric_statements(new).join(nb, "memory_id")
    num_old = numeric_statements(existing).join(eb, "memory_id").groupBy("concept", "attribute", "value").agg(
        F.count("*").alias("n")
    )
    old = num_old.withColumnRenamed("value", "old_value")
    numeric = (
        num_new.join(old, ["concept", "attribute"])
        .filter(F.col("value") != F.col("old_value"))
        .groupBy(F.col("memory_id").alias("new_id"))
        .agg(
            F.sum("n").alias("n_existing"),
            F.max(fx.numeric_conflict(F.col("value"), F.col("old_value"))).alias("confidence"),
        )
        .withColumn("kind", F.lit("numeric_range"))
    )
    ex_new = exclusive_statements(new).join(nb, "memory_id")
    ex_old = (
        exclusive_statements(existing)
        .join(eb, "memory_id")
        .groupBy("concept", "set_id", F.col("members").alias("old_members"))
        .agg(F.count("*").alias("n"))
    )
    exclusive = (
        ex_new.join(ex_old, ["concept", "set_id"])
        .filter(F.col("members") != F.col("old_members"))
        .groupBy(F.col("memory_id").alias("new_id"))
        .agg(F.sum("n").alias("n_existing"), F.lit(0.95).alias("confidence"))
        .withColumn("kind", F.lit("mutual_exclusion"))
    )
    return numeric.unionByName(exclusive).select("new_id", "kind", "n_existing", F.round("confidence", 6).alias("confidence"))


def register(conflicts: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Strongest conflict per unordered pair and kind, without resolved ones.

    ``conflicts`` (id_a, id_b, kind, confidence), ``resolved`` (id_a, id_b, kind).
    """
    keyed = conflicts.filter("id_a <> id_b AND confidence > 0").select(
        F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "kind", "confidence"
    )
    best = keyed.groupBy("id_a", "id_b", "kind").agg(F.max("confidence").alias("confidence"))
    if resolved is None:
        return best
    done = resolved.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "kind")
    return best.join(done.distinct(), ["id_a", "id_b", "kind"], "left_anti")


def conflicted_ids(conflicts: DataFrame) -> DataFrame:
    return conflicts.select(F.explode(F.array("id_a", "id_b")).alias("memory_id")).distinct()


def dispute_map(conflicts: DataFrame, memories: DataFrame) -> DataFrame:
    """(memory_id, rival_id, kind, confidence, rival_content): the dispute shown for each row.

    The highest-priority kind, then the strongest, then the smallest rival id.
    """
    turned = conflicts.select(
        F.col("id_a").alias("memory_id"), F.col("id_b").alias("rival_id"), "kind", "confidence"
    ).union(conflicts.select("id_b", "id_a", "kind", "confidence"))
    place = F.array_position(F.array(*[F.lit(k) for k in KIND_PRIORITY]), F.col("kind"))
    order = F.struct((-place).alias("p"), "confidence", (-F.col("rival_id")).alias("r"))
    best = turned.groupBy("memory_id").agg(F.max_by(F.struct("rival_id", "kind", "confidence"), order).alias("d"))
    rivals = memories.select(F.col("memory_id").alias("rival_id"), F.col("content").alias("rival_content"))
    return best.select("memory_id", "d.*").join(rivals, "rival_id", "left")


def with_fading(conflicts: DataFrame, memories: DataFrame) -> DataFrame:
    """Add the ``temporal_conflict`` row that each base conflict implies, faded by the time between the rows."""
    ta = memories.select(F.col("memory_id").alias("id_a"), F.col("created_at").alias("t_a"))
    tb = memories.select(F.col("memory_id").alias("id_b"), F.col("created_at").alias("t_b"))
    faded = (
        conflicts.join(ta, "id_a")
        .join(tb, "id_b")
        .withColumn("confidence", fx.faded_conflict(F.col("confidence"), F.col("t_a"), F.col("t_b")))
        .filter(F.col("confidence").isNotNull())
        .select("id_a", "id_b", F.lit("temporal_conflict").alias("kind"), "confidence")
    )
    return conflicts.select("id_a", "id_b", "kind", "confidence").union(faded)

"""Batch write: validate, apply the policy, find what each row supersedes, number, append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import lifecycle, retrieval, similarity, splits, store
from ..schema import MEMORY_TYPES

DUPLICATE_AT = 0.3


def checked(rows: DataFrame, now: float) -> DataFrame:
    """All rows with their times filled in and ``reason``, null where the row may be stored.

    ``valid_from`` defaults to ``observed_at``, which defaults to now.
    """

    def given(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("double")

    out = rows.withColumn("observed_at", F.coalesce(given("observed_at"), F.lit(now)))
    out = out.withColumn("valid_from", F.coalesce(given("valid_from"), F.col("observed_at")))
    out = out.withColumn("valid_to", given("valid_to"))
    reason = (
        F.when(F.coalesce(F.trim("content"), F.lit("")) == "", "empty text")
        .when(~F.coalesce(F.col("memory_type").isin(MEMORY_TYPES), F.lit(False)), "unknown type")
        .when(F.col("valid_to") < F.col("valid_from"), "ends before it starts")
    )
    return out.withColumn("reason", reason)


def rejected(rows: DataFrame, now: float) -> DataFrame:
    """The rows that are not stored, each with its reason."""
    return checked(rows, now).filter(F.col("reason").isNotNull())


def superseded(
    new: DataFrame, existing: DataFrame, new_bridge: DataFrame, bridge: DataFrame, threshold: float = DUPLICATE_AT
) -> DataFrame:
    """(memory_id, target_id, similarity): the existing row each new row replaces.

    Candidates are the ten best rows of a recall with the new text as query;
    the first one, in recall order, that is similar enough is taken.
    """
    queries = new.select(F.col("memory_id").alias("query_id"), F.col("content").alias("query"))
    ranked = retrieval.bm25_top(existing, queries, 10).select("query_id", "memory_id", "rank")

    def described(rows: DataFrame, links: DataFrame, key: str, tag: str) -> DataFrame:
        # A row's own concepts: bounded by the lexicon.
        cs = links.groupBy("memory_id").agg(F.collect_set("concept").alias(f"c_{tag}"))
        none = F.array().cast("array<string>")
        out = rows.select("memory_id", tx.token_set(F.col("content")).alias(f"w_{tag}")).join(cs, "memory_id", "left")
        return out.withColumn(f"c_{tag}", F.coalesce(f"c_{tag}", none)).withColumnRenamed("memory_id", key)

    # Only recalled rows are tokenised again.
    hit_rows = existing.join(ranked.select("memory_id").distinct(), "memory_id", "left_semi")
    both = ranked.join(described(new, new_bridge, "query_id", "a"), "query_id").join(
        described(hit_rows, bridge, "memory_id", "b"), "memory_id"
    )
    sim = similarity.blended_similarity(F.col("w_a"), F.col("w_b"), F.col("c_a"), F.col("c_b"))
    close = both.withColumn("similarity", sim).filter(F.col("similarity") >= threshold)
    return close.groupBy(F.col("query_id").alias("memory_id")).agg(
        F.min_by("memory_id", "rank").alias("target_id"), F.round(F.min_by("similarity", "rank"), 6).alias("similarity")
    )


def signature(content: Column) -> Column:
    return F.sha2(F.lower(F.trim(content)), 256)


def remember(rows: DataFrame, now: float, policy: dict | None = None, last_id: int = 0) -> DataFrame:
    """New memory rows, numbered after ``last_id`` and ready to append: every valid row, repeated texts included.

    ``rows``: content, memory_type, scope, shared_with, sensitive, metadata.
    What the new rows replace is said by edges: see ``equal_text_edges`` and
    ``superseded``. The rows that are refused are in ``rejected``.
    """
    ok = checked(rows, now).filter(F.col("reason").isNull()).drop("reason")
    if policy:
        ok = lifecycle.apply_write_policy(ok, policy)
    # The order takes in every column: rows that are equal in all of them may change places.
    marked = ok.withColumn("_sig", signature(F.col("content"))).withColumn("_row", F.xxhash64(*[F.col(c) for c in ok.columns]))
    numbered = store.assign_ids(marked, last_id, ["_sig", "_row"]).drop("_sig", "_row")
    return (
        numbered.withColumn("strength", F.lit(1.0))
        .withColumn("access_count", F.lit(0).cast("long"))
        .withColumn("created_at", F.lit(now))
        .withColumn("last_accessed", F.lit(now))
        .withColumn("memory_level", F.lit("instance"))
        .withColumn("consolidated", F.lit(False))
    )


#: New rows of one text per window task, in ids.
_CHAIN_SLICE = 10_000


def equal_text_edges(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(memory_id, target_id): each new row and the row with the same text that it replaces.

    That is the new row with the next smaller id, or, for the first of them,
    the newest stored one. A text that many rows share is a chain, cut into
    slices of ids, so that no task orders all of it.
    """
    sig = signature(F.col("content")).alias("sig")
    rows = new.select("memory_id", sig, F.col("memory_id").cast("double").alias("place"))
    chained = splits.with_neighbor(rows, ["sig"], "place", "memory_id", ["memory_id"], slice_seconds=_CHAIN_SLICE)
    stored = existing.groupBy(sig).agg(F.max("memory_id").alias("stored_id"))
    first = chained.filter(F.col("prev_memory_id").isNull()).join(stored, "sig")
    later = chained.filter(F.col("prev_memory_id").isNotNull())
    return first.select("memory_id", F.col("stored_id").alias("target_id")).unionByName(
        later.select("memory_id", F.col("prev_memory_id").alias("target_id"))
    )


def supersedes_edges(found: DataFrame, now: float) -> DataFrame:
    """Edges from each new row to the row it replaces."""
    return found.select(
        F.col("memory_id").alias("source_id"),
        "target_id",
        F.lit("supersedes").alias("edge_type"),
        F.lit(1.0).alias("weight"),
        F.lit(now).alias("created_at"),
    )

"""Claims with their support and their opposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import facts as fx


def claims(triples: DataFrame, memories: DataFrame) -> DataFrame:
    """(subject, predicate, object, polarity, claim, memory_id, created_at, confidence), one per memory and claim."""
    one = triples.groupBy("memory_id", "subject", "predicate", "object", "polarity").agg(
        F.min_by("confidence", "seq").alias("confidence")
    )
    text = fx.claim(F.col("subject"), F.col("predicate"), F.col("object"), F.col("polarity"))
    return one.withColumn("claim", text).join(memories.select("memory_id", "created_at"), "memory_id")


def evidence_chains(claim_rows: DataFrame) -> DataFrame:
    """Per claim: support, opposition, confidence and first/last confirmation.

    Opposition counts the memories behind the denial of the same statement; it
    follows from the group's totals, so no two claims are ever paired. Numeric
    and exclusive-value opposition is found by ``conflicts``. Supporting ids
    stay a relation (``claim_rows``).
    """
    sign = F.col("polarity")

    def side(value: str) -> list:
        mine = sign == value
        return [
            F.count_if(mine).alias(f"n_{value}"),
            F.avg(F.when(mine, F.col("confidence"))).alias(f"conf_{value}"),
            F.min(F.when(mine, F.col("created_at"))).alias(f"first_{value}"),
            F.max(F.when(mine, F.col("created_at"))).alias(f"last_{value}"),
        ]

    # Both sides of a statement come out of one aggregate.
    both = claim_rows.groupBy("subject", "predicate", "object").agg(*side("positive"), *side("negative"))

    def row(value: str, other: str):
        return F.struct(
            F.lit(value).alias("polarity"),
            F.col(f"n_{value}").alias("n_supporting"),
            F.col(f"n_{other}").alias("n_contradicting"),
            F.col(f"conf_{value}").alias("support"),
            F.col(f"first_{value}").alias("first_seen"),
            F.col(f"last_{value}").alias("last_confirmed"),
        )

    rows = both.select(
        "subject", "predicate", "object", F.inline(F.array(row("positive", "negative"), row("negative", "positive")))
    ).filter("n_supporting > 0")
    penalty = F.least(F.lit(0.4), 0.1 * F.col("n_contradicting"))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("support") - penalty))
    return rows.select(
        fx.claim(F.col("subject"), F.col("predicate"), F.col("object"), sign).alias("claim"),
        "n_supporting",
        "n_contradicting",
        F.round(conf, 6).alias("confidence"),
        "first_seen",
        "last_confirmed",
    )


def query_triples(triples: DataFrame, subject: str | None = None, predicate: str | None = None, obj: str | None = None) -> DataFrame:
    """Triples that match every given part, compared in canonical form."""
    from ..functions.text import canonical

    out = triples
    if subject is not None:
        out = out.filter(F.col("subject") == canonical(F.lit(subject)))
    if predicate is not None:
        out = out.filter(F.col("predicate") == F.lit(predicate.strip().lower()))
    if obj is not None:
        out = out.filter(F.col("object") == canonical(F.lit(obj)))
    return out


def triple_edges(triples: DataFrame) -> DataFrame:
    """(concept, neighbor, edge_type, weight): triples as concept-graph edges, both directions."""
    kind = F.when(F.col("confidence") >= 0.7, "factual").otherwise("derived")
    fwd = triples.groupBy(F.col("subject").alias("concept"), F.col("object").alias("neighbor"), kind.alias("edge_type")).agg(
        F.max("confidence").alias("weight")
    )
    back = fwd.select(F.col("neighbor").alias("concept"), F.col("concept").alias("neighbor"), "edge_type", "weight")
    return fwd.unionByName(back)

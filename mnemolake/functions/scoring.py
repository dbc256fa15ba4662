"""Strength, decay, activation and term-weight formulas as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BM25_B, BM25_K1, CONCEPT_HALF_LIFE, DAY, DECAY_HALF_LIFE, MAX_STRENGTH, REINFORCE_STEP


def half_life(age: Column, period: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / F.lit(period))


def recency(last_accessed: Column, now: float) -> Column:
    return half_life(F.lit(now) - last_accessed, DECAY_HALF_LIFE)


def effective_strength(strength: Column, access_count: Column, last_accessed: Column, now: float) -> Column:
    """strength x 7-day decay x (1 + 0.1 ln(1 + accesses))."""
    decay = F.pow(F.lit(0.5), (F.lit(now) - last_accessed) / F.lit(DECAY_HALF_LIFE))
    return strength * decay * (1 + 0.1 * F.log1p(access_count.cast("double")))


def reinforced(strength: Column, hits: Column) -> Column:
    """Strength after ``hits`` accesses: one step each, capped."""
    return F.least(strength + F.lit(REINFORCE_STEP) * hits, F.lit(MAX_STRENGTH))


def activation(count: Column, last_activated: Column, now: float) -> Column:
    """Concept heat in [0, 1]: saturating frequency times a 30-day half-life."""
    freq = 1 - F.exp(-count.cast("double") / 5)
    heat = freq * half_life(F.lit(now) - last_activated, CONCEPT_HALF_LIFE)
    return F.when(count > 0, F.least(F.greatest(heat, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def bm25_idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.greatest(F.lit(1.1), (n_docs - df + 0.5) / (df + 0.5)))


def bm25_tf(tf: Column, doc_len: Column, avg_len: Column) -> Column:
    norm = F.lit(1 - BM25_B) + F.lit(BM25_B) * doc_len / avg_len
    return tf * (BM25_K1 + 1) / (tf + F.lit(BM25_K1) * norm)


def older_than(created_at: Column, days: Column | float, now: float) -> Column:
    limit = days if isinstance(days, Column) else F.lit(float(days))
    return (F.lit(now) - created_at) > limit * F.lit(DAY)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays; 0 when either has no length."""

    def dot(x: Column, y: Column) -> Column:
        parts = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """|A n B| / |A u B| of two distinct-element arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)

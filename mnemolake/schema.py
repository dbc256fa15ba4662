"""Row shapes and the constants of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
MEMORY_TYPES = ["fact", "preference", "skill", "observation", "event", "semantic", "consolidated"]
SCOPES = ["public", "shared", "private"]
LEVELS = ["instance", "pattern", "profile"]
DAY = 86400.0
DECAY_HALF_LIFE = 7 * DAY
CONCEPT_HALF_LIFE = 30 * DAY
REINFORCE_STEP = 0.05
MAX_STRENGTH = 2.0
EPISODE_WINDOW = 1800.0
BM25_K1 = 1.5
BM25_B = 0.75

MEMORY = T.StructType(
    [
        T.StructField("memory_id", T.LongType(), False),
        T.StructField("content", T.StringType(), False),
        T.StructField("memory_type", T.StringType()),
        T.StructField("memory_level", T.StringType()),
        T.StructField("scope", T.StringType()),
        T.StructField("shared_with", T.ArrayType(T.StringType())),
        T.StructField("sensitive", T.BooleanType()),
        T.StructField("strength", T.DoubleType()),
        T.StructField("access_count", T.LongType()),
        T.StructField("created_at", T.DoubleType()),
        T.StructField("last_accessed", T.DoubleType()),
        T.StructField("observed_at", T.DoubleType()),
        T.StructField("valid_from", T.DoubleType()),
        T.StructField("valid_to", T.DoubleType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("consolidated", T.BooleanType()),
        T.StructField("summary_of", T.ArrayType(T.LongType())),
    ]
)

EDGE = T.StructType(
    [
        T.StructField("source_id", T.LongType(), False),
        T.StructField("target_id", T.LongType(), False),
        T.StructField("edge_type", T.StringType(), False),
        T.StructField("weight", T.DoubleType()),
        T.StructField("created_at", T.DoubleType()),
    ]
)

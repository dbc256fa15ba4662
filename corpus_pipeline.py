"""A training-data pipeline over the table ``documents``.

Each stage reads all that the stage before it kept, and writes it as Parquet. All stages but the last return the
columns of ``documents``; the last returns pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm import exact_dedup, jaccard_dedup, packing, pii, quality
from mnemolake.llm.common import aside
from mnemolake.llm.queries import JSON, SURROGATE_KEY
from mnemolake.session import save

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id."""
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by pairs with a Jaccard similarity of five-word shingles of 0.8 or more, the smallest doc_id.

    Texts linked by their SimHash fingerprints are checked first, then what the fingerprints miss is found by shingles.
    """
    return jaccard_dedup.near_dedup(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Private entities replaced; n_chars follows the new text."""
    rows, own = aside(docs, ["n_entities"])
    out = pii.pseudonymise(rows, SURROGATE_KEY)
    if "n_chars" in docs.columns:
        new = F.when(F.col("n_entities") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", new.otherwise(F.col("n_chars")))
    return out.select(*own)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 token ids, with their ids and a checksum of them."""
    return packing.pack(docs, JSON).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("pii_surrogates", surrogates),
    ("packing", pack),
]

#: SQL knows neither the surrogates nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Registered queries of the training-data operators, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, chat, exact_dedup, hmm_lm, packing, pii, quality, rans, simhash, spelling, suffix_dedup, weak_quality

Query = Callable[[SparkSession, str], DataFrame]

JSON = public_tokenizers.path("byte_bpe_50k.json")
#: Key of the registered query and of the pipeline; whoever runs them on private data sets their own.
SURROGATE_KEY = "surrogates-of-the-given-tables"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_array_dedup(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_surrogates(documents(spark, sf_dir), SURROGATE_KEY)


def op6_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.rans_files(documents(spark, sf_dir), JSON)


def op7_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.weak_quality(documents(spark, sf_dir))


def op8_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.hmm_scores(documents(spark, sf_dir))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_dedup(documents(spark, sf_dir))


def op10_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.cost_packing(documents(spark, sf_dir), JSON)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_formatting(spark.read.parquet(f"{sf_dir}/conversations.parquet"), JSON)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_byte_bpe,
        op3_suffix_dedup,
        op4_quality_rules,
        op5_pii_surrogates,
        op6_rans_files,
        op7_weak_quality,
        op8_hmm_scores,
        op9_simhash_near_dedup,
        op10_cost_packing,
        op11_spelling_variants,
        op12_centroid_clusters,
        op13_chat_formatting,
    )
}
SQL: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.EXACT_DEDUP_SQL,
    "op4_quality_rules": quality.QUALITY_SQL,
    "op11_spelling_variants": spelling.SPELLING_SQL,
    "op12_centroid_clusters": centroids.clusters_sql(),
    "op13_chat_formatting": chat.CHAT_SQL,
}


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and SQL, with the pipeline at the top of the repository."""
    pipeline = import_module("corpus_pipeline")
    sql = dict(SQL) if pipeline.ORACLE_SQL is None else {**SQL, "pipeline": pipeline.ORACLE_SQL}
    return {**QUERIES, "pipeline": pipeline.run}, sql

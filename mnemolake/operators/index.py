"""Term statistics over memory text.

Generators over computed arrays are the ``_outer`` kind followed by a null
filter: for a plain ``explode`` Spark adds a filter that computes the array a
second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def tokenized(memories: DataFrame, id_col: str = "memory_id", text_col: str = "content") -> DataFrame:
    """(memory_id, words, dl); rows without any token carry no index entry."""
    low = F.lower(F.col(text_col))
    return (
        # A cheap first-match test, so that the full tokenising runs once per row.
        memories.filter(low.rlike("[a-z0-9]"))
        .select(F.col(id_col).alias("memory_id"), tx.tokens(F.col(text_col)).alias("words"))
        .withColumn("dl", F.size("words").cast("long"))
    )


def lengths(memories: DataFrame, id_col: str = "memory_id", text_col: str = "content") -> DataFrame:
    """(memory_id, dl): token count per row, zero included."""
    dl = F.regexp_count(F.lower(F.col(text_col)), F.lit("[a-z0-9]+")).cast("long")
    return memories.select(F.col(id_col).alias("memory_id"), dl.alias("dl"))


def corpus_stats(lens: DataFrame) -> DataFrame:
    """One row over rows with tokens: number of documents, token count, mean and maximum length.

    Empty rows are skipped inside the aggregates: as a filter the token count
    would be evaluated a second time.
    """
    dl = F.nullif("dl", F.lit(0))
    return lens.agg(
        F.count(dl).alias("n_docs"),
        F.sum(dl).alias("n_tokens"),
        F.avg(dl).alias("avg_len"),
        F.max(dl).alias("max_len"),
    )


def term_sets(memories: DataFrame, id_col: str = "memory_id", text_col: str = "content") -> DataFrame:
    """(memory_id, term): each distinct term of each row once; no shuffle."""
    distinct = F.array_distinct(tx.tokens(F.col(text_col)))
    rows = memories.select(F.col(id_col).alias("memory_id"), F.explode_outer(distinct).alias("term"))
    return rows.filter(F.col("term").isNotNull())


def postings(tok: DataFrame) -> DataFrame:
    """(memory_id, dl, term, tf) for every distinct term of every document.

    Sorts each row's tokens and measures the runs of equal ones, so counting
    term frequencies needs no shuffle.
    """
    words = F.col("words")
    run_starts = F.filter(
        F.sequence(F.lit(1), F.size(words)),
        lambda i: (i == 1) | (F.element_at(words, i) != F.element_at(words, F.greatest(i - 1, F.lit(1)))),
    )
    runs = F.zip_with(
        F.col("starts"),
        F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size(words) + 1)),
        lambda a, b: F.struct(F.element_at(words, a).alias("term"), (b - a).cast("long").alias("tf")),
    )
    return (
        tok.select("memory_id", "dl", F.sort_array("words").alias("words"))
        .withColumn("starts", run_starts)
        .select("memory_id", "dl", F.inline_outer(runs))
        .filter(F.col("term").isNotNull())
    )


def document_frequency(tok: DataFrame) -> DataFrame:
    """(term, df, cf): documents holding the term and total occurrences.

    One shuffle on the term after map-side sums: a stop word costs one row per task.
    """
    return postings(tok).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


#: Folders that postings are dealt to by term. Fixed, so that batches written at different times share them.
TERM_BUCKETS = 64


def _bucket(term: str = "term"):
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def write_index(memories: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist postings clustered by a term bucket, so that a query reads few files; ``append`` adds a batch.

    A term that very many rows hold is spread over several files of its bucket.
    """
    (
        postings(tokenized(memories))
        .withColumn("bucket", _bucket())
        .repartition("bucket", F.pmod(F.xxhash64("memory_id"), F.lit(8)))
        .sortWithinPartitions("bucket", "term", "memory_id")
        .write.mode(mode)
        .partitionBy("bucket")
        .parquet(f"{path}/postings")
    )
    corpus_stats(lengths(memories)).select("n_docs", "n_tokens").write.mode(mode).parquet(f"{path}/corpus")
    if mode == "overwrite":
        memories.select("memory_id", F.lit(0).cast("long").alias("dl")).limit(0).write.mode(mode).parquet(f"{path}/removed")


def remove_from_index(memories: DataFrame, path: str) -> None:
    """Note rows as removed, with their lengths; their postings stay until the index is written anew."""
    lengths(memories).write.mode("append").parquet(f"{path}/removed")


def index_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row (n_docs, avg_len) over all batches without the removed rows."""
    gone = spark.read.parquet(f"{path}/removed").distinct()
    parts = spark.read.parquet(f"{path}/corpus").unionByName(
        gone.agg((-F.count(F.nullif("dl", F.lit(0)))).alias("n_docs"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("n_tokens"))
    )
    total = parts.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return total.select("n_docs", (F.col("n_tokens") / F.col("n_docs")).alias("avg_len"))


def read_postings(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """(memory_id, term, tf, dl) of the given terms; only their buckets are read.

    The bucket numbers, at most TERM_BUCKETS, come to the driver and prune the
    folders before the scan.
    """
    wanted = terms.select("term").distinct()
    buckets = [r.bucket for r in wanted.select(_bucket().alias("bucket")).distinct().collect()]
    held = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(buckets))
    live = held.join(spark.read.parquet(f"{path}/removed").select("memory_id"), "memory_id", "left_anti")
    return live.join(wanted, "term", "left_semi").select("memory_id", "term", "tf", "dl")

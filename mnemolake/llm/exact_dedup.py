"""Exact dedup: two passes of a blocked Bloom filter, then a shuffle of the possibly repeated rows only.

Pass one sets FILTER_BITS bits per text hash in blocks of 32 768 bits and keeps the bits that were hit at least twice.
Pass two tests every row against that filter. A text whose bits are not all doubly hit is certainly single: its row
goes straight to the result. The others are grouped by their SHA-256, which settles false positives.

Only built-in functions run here. The texts are never shuffled in pass one; of a table of n rows, n hashes are counted
with map-side combine, so copies of one text reach the shuffle once per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import save
from .common import BLANK, HOT_SHARE, aside, whole_text

BLOCK_BITS = 32768  # what bitmap_construct_agg holds
BITS_PER_ROW = 16
FILTER_BITS = 2
#: A filter up to this size, that of 33 million rows, is broadcast. A larger one is joined by block: the hashes, and where
#: ``mark`` is asked for whole rows those rows, then move once to the block they are tested against.
BROADCAST_BYTES = 64 << 20

RESULT = ["keep_id", "group_size", "kept", "text_sha256"]


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the text with each run of blanks replaced by one space."""
    return F.sha2(F.regexp_replace(text, BLANK, " ").cast("binary"), 256)


def _bits(sha: str) -> Column:
    """The two bits of a hash within its block."""
    h = F.hash(F.col(sha)).cast("long")
    low = h.bitwiseAND(F.lit(BLOCK_BITS - 1))
    high = F.shiftright(h, 15).bitwiseAND(F.lit(BLOCK_BITS - 1))
    return F.array_distinct(F.array(low, high))


def _block(sha: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(sha)), F.lit(blocks))


def repeated_filter(digests: DataFrame, blocks: int) -> DataFrame:
    """(_block, _bitmap): the bits that at least two rows hit. One row of 4 KB per block."""
    return (
        digests.select(_block("text_sha256", blocks).alias("_block"), F.explode(_bits("text_sha256")).alias("_bit"))
        .groupBy("_block", "_bit")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .groupBy("_block")
        .agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    )


def _is_set(bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring("_bitmap", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.getbit(byte.cast("long"), bit.bitwiseAND(F.lit(7))) == 1


class ExactDedup:
    """Groups of equal texts of one table.

    Of equal texts the row with the smallest ``id`` stays. Null texts count as empty; a null id comes after all
    others. Rows repeated with one id and one text keep one row, chosen by a hash of all their columns. An empty table
    gives an empty result. Columns of the input that are named like a result column are replaced.
    """

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text"):
        self.id, self.text = id, text
        self.digests = save(docs.select(F.col(id), digest(whole_text(text)).alias("text_sha256")), "digests")
        rows = self.digests.count()
        self.blocks = max(1, -(-rows * BITS_PER_ROW // BLOCK_BITS))
        self.filter = save(repeated_filter(self.digests, self.blocks), "bloom")
        suspects = self._tested(self.digests).filter("_maybe")
        smallest = F.min(F.struct(F.col(id).isNull().alias("last"), F.col(id), "rows"))
        self.groups = save(
            suspects.groupBy("text_sha256", id)
            .agg(F.count("*").alias("rows"))
            .groupBy("text_sha256")
            .agg(smallest.alias("m"), F.sum("rows").alias("group_size"))
            .select("text_sha256", F.col("m")[id].alias("keep_id"), "group_size", F.col("m.rows").alias("_firsts")),
            "groups",
        )

    def _tested(self, rows: DataFrame) -> DataFrame:
        small = self.blocks * BLOCK_BITS // 8 <= BROADCAST_BYTES
        bitmaps = F.broadcast(self.filter) if small else self.filter
        found = rows.withColumn("_block", _block("text_sha256", self.blocks)).join(bitmaps, "_block", "left")
        every = F.forall(_bits("text_sha256"), _is_set)
        return found.withColumn("_maybe", F.col("_bitmap").isNotNull() & every).drop("_block", "_bitmap")

    def mark(self, docs: DataFrame, digests: DataFrame | None = None) -> DataFrame:
        """All rows and columns of ``docs`` with keep_id, group_size, kept and text_sha256."""
        if digests is None:
            bare = docs.drop(*RESULT)
            digests = bare.withColumn("text_sha256", digest(whole_text(self.text)))
        total, firsts = self.groups.agg(F.sum("group_size"), F.max("_firsts")).first()
        hot = F.col("group_size") * HOT_SHARE > (total or 0)  # at most HOT_SHARE groups
        tested = self._tested(digests).join(F.broadcast(self.groups.filter(hot)), "text_sha256", "left")
        met = F.col("keep_id").isNotNull() | F.col("group_size").isNotNull()
        alone = tested.filter(~F.col("_maybe") | met).withColumns(
            {
                "keep_id": F.when(F.col("_maybe"), F.col("keep_id")).otherwise(F.col(self.id)),
                "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
            }
        )
        rest = tested.filter(F.col("_maybe") & ~met).drop("keep_id", "group_size", "_firsts")
        found = alone.unionByName(rest.join(self.groups.filter(~hot), "text_sha256"))
        first = F.col(self.id).eqNullSafe(F.col("keep_id"))
        if (firsts or 1) == 1:
            return found.withColumn("kept", first).drop("_maybe", "_firsts")
        # The table repeats an id with one text: of the rows that carry the id which stays, one stays.
        again = Window.partitionBy("text_sha256", self.id).orderBy(F.xxhash64(*[F.col(c) for c in digests.columns]))
        ahead = found.filter(first).withColumn("kept", F.row_number().over(again) == 1)
        behind = found.filter(~first).withColumn("kept", F.lit(False))
        return ahead.unionByName(behind).drop("_maybe", "_firsts")

    def decisions(self) -> DataFrame:
        """(id, keep_id, group_size, kept, text_sha256) for every row, without reading a text again."""
        return self.mark(self.digests, self.digests).select(self.id, *RESULT)


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns, those named like a result column included."""
    rows, own = aside(docs, RESULT)
    return ExactDedup(rows, id, text).mark(rows).filter("kept").select(*own)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """op1: one row per document."""
    return ExactDedup(docs).decisions()


EXACT_DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

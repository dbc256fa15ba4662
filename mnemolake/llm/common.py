"""Small helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word separators of all contracts: space and the ASCII controls tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"

#: A key is hot when it holds more than this share of all rows. The sizes add up to the number of rows, so at most
#: HOT_SHARE keys can be hot: a proven bound for the broadcast.
HOT_SHARE = 4096


def whole_text(name: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Words of a text as an array, empty for a blank text."""
    bare = F.btrim(text, F.lit(BLANK_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK))


def attach(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per key and the number of its rows in ``size``.

    Hot keys join by broadcast (at most HOT_SHARE of them), so that their rows never meet in one task; the others by
    shuffle, where no key has more than one HOT_SHARE-th of all rows.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE > total
    hot = F.broadcast(table.filter(is_hot))
    cold = table.filter(~is_hot)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def aside(docs: DataFrame, taken: list[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns that are named like one in ``taken`` out of the way, and what selects all columns again."""
    moved = {c: f"_own_{c}" for c in docs.columns if c in taken}
    return docs.withColumnsRenamed(moved), [F.col(moved.get(c, c)).alias(c) for c in docs.columns]

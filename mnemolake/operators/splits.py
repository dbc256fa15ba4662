"""Ordered neighbours (lag, lead, running order) that survive a hot key.

A plain window on a key puts all of the key's rows in one task. Here each
key's timeline is cut into time slices: a window per (key, slice) does the
bulk, and only the first and last row of each slice meet in a second window
per key, whose size is bounded by the number of slices, not of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DAY


def with_neighbor(
    df: DataFrame,
    keys: list[str],
    time: str,
    tie: str,
    values: list[str],
    forward: bool = False,
    slice_seconds: float = DAY,
) -> DataFrame:
    """Add ``prev_<v>`` (or ``next_<v>``) of the neighbouring row of the same key in (time, tie) order."""
    name = "next_" if forward else "prev_"
    sliced = df.withColumn("_slice", F.floor(F.col(time) / slice_seconds))
    order = [F.col(time), F.col(tie)]
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    pick = F.struct(*values)
    step = F.lead if forward else F.lag
    near = sliced.withColumn("_near", step(pick).over(inside)).withColumn("_rn", F.row_number().over(inside))
    near = near.withColumn("_far_end", F.lead(F.lit(1)).over(inside).isNull())
    # Rows whose neighbour lies in another slice.
    edge = F.col("_far_end") if forward else F.col("_rn") == 1
    whole = Window.partitionBy(*keys).orderBy(*order)
    ends = near.filter(F.col("_far_end") | (F.col("_rn") == 1))
    stitched = ends.withColumn("_near", step(pick).over(whole)).filter(edge)
    out = near.filter(~edge).unionByName(stitched)
    for v in values:
        out = out.withColumn(name + v, F.col("_near")[v])
    return out.drop("_slice", "_near", "_rn", "_far_end")


def with_position(
    df: DataFrame, keys: list[str], time: str, tie: str, name: str = "version", slice_seconds: float = DAY
) -> DataFrame:
    """Add the 1-based position of each row within its key in (time, tie) order."""
    sliced = df.withColumn("_slice", F.floor(F.col(time) / slice_seconds))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_slice").orderBy(time, tie)
    return (
        sliced.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_slice"])
        .withColumn(name, (F.col("_off") + F.col("_rn")).cast("long"))
        .drop("_slice", "_off", "_rn")
    )


def islands(df: DataFrame, keys: list[str], time: str, tie: str, starts, slice_seconds: float = DAY) -> DataFrame:
    """Add ``island``: how many start rows the key has seen up to and including the row.

    ``starts`` is a boolean column marking the first row of an island.
    """
    marked = df.withColumn("_start", F.when(starts, 1).otherwise(0)).withColumn(
        "_slice", F.floor(F.col(time) / slice_seconds)
    )
    counts = marked.groupBy(*keys, "_slice").agg(F.sum("_start").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy(time, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        marked.withColumn("_run", F.sum("_start").over(inside))
        .join(offsets, [*keys, "_slice"])
        .withColumn("island", (F.col("_off") + F.col("_run")).cast("long"))
        .drop("_slice", "_start", "_off", "_run")
    )

"""Global order without a single task: numbering and running minima over range partitions.

A window without PARTITION BY sends all rows to one task. Here rows are cut into ranges of the order's columns, as many
as the number of rows asks for, sorted there and written once, each with its range and its place in it. A tiny table of one row a range gives
each range its start. Small inputs are one range and one window. The order's columns together should tell rows apart:
then no value is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from tesselix.sources.storage import materialise

ROWS_PER_RANGE = 1_000_000
#: Ranges at most, whatever the rows: so many rows of two numbers are broadcast, and Spark's sample tells so many apart.
MOST_RANGES = 20_000


def ranged(df: DataFrame, order: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame | None:
    """df with _range and _at (from 0 in each range), ranges and places in the given order; None if one range holds all."""
    n = min(1 + df.count() // rows_per_range, MOST_RANGES)
    if n == 1:
        return None
    # the number is partition << 33 | row in it, and what is written stays so
    cut = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return materialise(cut, "ranged").withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})


def numbered(df: DataFrame, order: list[str], out: str = "rn", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """row_number() over (order by order), from 1."""
    cut = ranged(df, order, rows_per_range)
    if cut is None:
        return df.withColumn(out, F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # fewer rows than a range has
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    # starts: MOST_RANGES rows of two numbers at most
    return cut.join(F.broadcast(starts), "_range").withColumn(out, (F.col("_s") + F.col("_at") + 1).cast("bigint")).drop("_range", "_at", "_s")


def running_min_before(df: DataFrame, order: list[str], value: str, out: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """min(value) of all rows before, in order; null for the first."""
    cut = ranged(df, order, rows_per_range)
    if cut is None:
        return df.withColumn(out, F.min(value).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("_range").agg(F.min(value).alias("_n")).select("_range", F.min("_n").over(before).alias("_s"))
    within = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own: Column = F.min(value).over(within)
    return cut.join(F.broadcast(starts), "_range").withColumn(out, F.least(F.col("_s"), own)).drop("_range", "_at", "_s")  # least() skips nulls

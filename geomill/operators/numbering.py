"""Consecutive numbers without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _before(sums: DataFrame, width: int) -> DataFrame:
    """(_range, _before) of (_range, s): the sum of all ranges before, through ranges of ranges, so that a global window sees a row for each width * width keys."""
    grouped = sums.withColumn("_top", F.floor(F.col("_range") / width))
    top = grouped.groupBy("_top").agg(F.sum("s").alias("t"))
    top = top.select("_top", (F.sum("t").over(Window.orderBy("_top")) - F.col("t")).alias("_earlier"))
    own = F.sum("s").over(Window.partitionBy("_top").orderBy("_range")) - F.col("s")
    return grouped.join(top, "_top").select("_range", (F.col("_earlier") + own).alias("_before"))


def numbered(df: DataFrame, key: str, name: str, width: int = 1 << 16) -> DataFrame:
    """Number rows from 0 in the order of a unique whole-number key.

    Rows are counted for each range of `width` keys, the counts (one row a range) are
    summed up in ranges of ranges, and a row's number is its place in its range plus the rows before.
    """
    ranged = df.withColumn("_range", F.floor(F.col(key) / width))
    before = _before(ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("s")), width)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranged.join(before, "_range").withColumn(name, F.col("_before") + place - 1).drop("_range", "_before")


def exclusive_scan(df: DataFrame, key: str, value: str, name: str, width: int = 1 << 16) -> DataFrame:
    """Sum of `value` over all rows with a smaller unique key, by sums of ranges of keys (one row a range) and windows inside them."""
    ranged = df.withColumn("_range", F.floor(F.col(key) / width))
    sums = _before(ranged.groupBy("_range").agg(F.sum(value).alias("s")), width)
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(key)) - F.col(value)
    return ranged.join(sums, "_range").withColumn(name, F.col("_before") + own).drop("_range", "_before")

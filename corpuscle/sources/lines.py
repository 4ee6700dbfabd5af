"""Numbers that run over rows in order, without one task that orders them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, keys: list[str], bucket: str, order: str, value: Column, name: str) -> DataFrame:
    """rows with the sum of value over all rows before and with each: in a bucket by a window, over buckets by their sums."""
    sums = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_n"))
    before = sums.select(*keys, bucket, (F.sum("_n").over(Window.partitionBy(*keys).orderBy(bucket)) - F.col("_n")).alias("_before"))
    own = F.sum(value).over(Window.partitionBy(*keys, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(before, [*keys, bucket]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before")

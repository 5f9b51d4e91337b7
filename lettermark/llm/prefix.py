"""Running totals over a global order without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lettermark.session import cut_lineage


def running_total(df: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """The rows with the running total of each value, itself included, in the given order.

    The rows are range-partitioned and written; the totals of the ranges, one row each, are summed first, so that only
    the inside of a range is a window. Rows that are equal in the order and everywhere else take any order.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    sums = ranged.groupBy("range_").agg(*[F.sum(v).alias(f"{k}_sum") for k, v in values.items()])
    before = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    starts = sums.select("range_", *[F.coalesce(F.sum(f"{k}_sum").over(before), F.lit(0)).alias(f"{k}_before") for k in values])
    inside = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = [(F.col(f"{k}_before") + F.sum(v).over(inside)).alias(k) for k, v in values.items()]
    return ranged.join(starts, "range_").select(*df.columns, *totals)

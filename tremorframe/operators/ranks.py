"""Ranks and numbers of all rows, without bringing the rows to one task.

Values are dealt into ranges, one per partition. The rows of each partition come
to the driver as one sum, whose running totals are where the ranges begin; the
rest is counted inside the ranges. Equal values are counted before they are dealt, so
a frequent value is one row however many rows hold it, and no tie crosses a border.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from tremorframe.session import stage_table


def _starts(counts: DataFrame, value: str, descending: bool) -> DataFrame:
    """``counts`` (unique ``value``, ``_n``) with ``_before``, the rows in front of each value."""
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_first()
    ranged = stage_table(counts.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_range").agg(F.sum("_n").alias("n")).orderBy("_range").collect()  # a row per partition
    begins = dict(zip((r["_range"] for r in sums), accumulate((r["n"] for r in sums), initial=0)))
    begin: Column = F.lit(0).cast("bigint")
    if begins:
        begin = F.create_map(*[F.lit(x) for pair in begins.items() for x in pair])[F.col("_range")].cast("bigint")
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_n").over(inside), F.lit(0).cast("bigint"))
    return ranged.withColumn("_before", begin + earlier).drop("_range", "_n")


def with_rank(df: DataFrame, value: str, name: str, descending: bool = True) -> DataFrame:
    """Add the rank of ``value`` among all rows, from 1, equal values sharing the first one's; nulls come last when descending."""
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    starts = _starts(counts, value, descending).withColumnRenamed(value, "_value")
    # equal to itself where null; a frequent value is split by AQE
    ranked = df.join(starts, F.col(value).eqNullSafe(F.col("_value")), "left")
    return ranked.withColumn(name, F.col("_before") + 1).drop("_value", "_before")


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """The distinct values of ``key`` numbered from 0 in their order."""
    ones = df.select(key).distinct().withColumn("_n", F.lit(1).cast("bigint"))
    return _starts(ones, key, descending=False).withColumnRenamed("_before", name)

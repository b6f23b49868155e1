"""Running totals over a whole table, without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.runtime import materialize


def running_total_by(df: DataFrame, by: str, value: str, order: list[str], out: str = "before") -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``by`` that come before in ``order``; a hot ``by`` is spread over many tasks."""
    placed = running_total(df, value, [by, *order], "_before")
    starts = placed.groupBy(F.col(by).alias("_by")).agg(F.min("_before").alias("_from"))
    return placed.join(starts, F.col(by).eqNullSafe(F.col("_by"))).withColumn(out, F.col("_before") - F.col("_from")).drop("_by", "_from", "_before")


def running_total(df: DataFrame, value: str, order: list[str], out: str = "before") -> DataFrame:
    """Adds ``out``: the sum of ``value`` (not negative) over all rows that come before in ``order``.

    Two levels: rows are range-partitioned and written; sums within partitions are
    windows of one partition, sums before partitions a window over one row each.
    ``order`` must be unique for a defined result.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    own = ranged.withColumn("_own", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return own.join(F.broadcast(starts), "_part").withColumn(out, F.col("_own") + F.col("_start")).drop("_part", "_own", "_start")  # one row a partition is broadcast

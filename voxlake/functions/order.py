"""Positions and running sums over a whole table, without a window that one task holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize


def running(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows up to and with this one, in ``order`` (whose keys are unique).

    Rows are dealt into ranges and summed within each; the ranges before a range are one row each, so
    their sums are a table of as many rows as there are partitions.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(rows.withColumn("_value", value).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "running")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(F.sum("_value").alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.sum("_value").over(inside)).drop("_value", "_range", "_start")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the position from 1 in ``order``."""
    return running(rows, order, F.lit(1).cast("long"), name)

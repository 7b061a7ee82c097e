"""Volumes as voxel tables (z, y, x, v): derived from a table, generated by a formula, or read from dense blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import dense_grid


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels_from_lineitem(lineitem: DataFrame, dim: int) -> DataFrame:
    """The derived volume: order lines hashed to a cube of ``dim``, the largest value where several meet."""
    v = F.when(F.col("l_returnflag") == "N", F.lit(0)).otherwise(1 + F.floor(F.col("l_quantity") * 5)).cast("int")
    rows = lineitem.select(
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % dim).cast("int").alias("z"),
        ((F.col("l_partkey") * 3 + F.col("l_suppkey")) % dim).cast("int").alias("y"),
        ((F.col("l_partkey") + F.col("l_linenumber") * 5) % dim).cast("int").alias("x"),
        v.alias("v"),
    )
    return rows.groupBy("z", "y", "x").agg(F.max("v").alias("v"))


def vox(spark, sf_dir: str, dim: int = 32) -> DataFrame:
    return voxels_from_lineitem(read_table(spark, sf_dir, "lineitem"), dim)


def vox_sql(dim: int = 32) -> str:
    """The same volume in DuckDB."""
    return f"""SELECT CAST((l_orderkey * 7 + l_linenumber) % {dim} AS INTEGER) AS z, CAST((l_partkey * 3 + l_suppkey) % {dim} AS INTEGER) AS y,
      CAST((l_partkey + l_linenumber * 5) % {dim} AS INTEGER) AS x,
      CAST(max(CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 + floor(l_quantity * 5) END) AS INTEGER) AS v FROM lineitem GROUP BY 1, 2, 3"""


def volume_from_function(spark, nz: int, ny: int, nx: int, value: Column) -> DataFrame:
    """Every voxel of a box with a value computed from z, y and x, clamped to 0..255."""
    return dense_grid(spark, nz, ny, nx).withColumn("v", F.least(F.greatest(value, F.lit(0)), F.lit(255)).cast("int"))


def grid_sql(nz: int, ny: int, nx: int) -> str:
    return f"SELECT CAST(i // {ny * nx} AS INTEGER) AS z, CAST((i // {nx}) % {ny} AS INTEGER) AS y, CAST(i % {nx} AS INTEGER) AS x FROM range({nz * ny * nx}) t(i)"

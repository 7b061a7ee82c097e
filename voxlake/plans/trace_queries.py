"""Queries of residuals, least squares, distance fields, seeds and growth over points that the tables' rows place."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.coords import AXES, dense_grid
from ..operators import segment as P
from ..operators import trace as T
from ..sources.volumes import read_table
from .register import query
from .segment_queries import _noisy_sheet

UNIT, EDGE, N = 10.0, 5, 24
COS30 = repr(T.COS30)


@query("t1_least_squares", "SELECT s_suppkey AS sid, s_suppkey % 50 + 0.0e0 AS x, s_nationkey + 0.0e0 AS y, s_suppkey % 7 + 0.0e0 AS z FROM supplier")
def t1(spark, sf):
    """Suppliers found again from four points at distance 10 of each, one more of which is wrong and weighs little."""
    s = read_table(spark, sf, "supplier")
    x, y, z = (c.cast("double") for c in (F.col("s_suppkey") % 50, F.col("s_nationkey"), F.col("s_suppkey") % 7))
    around = [(10.0, 0, 0), (0, 10.0, 0), (0, 0, 10.0), (-6.0, -8.0, 0), (0, -6.0, -8.0), (-8.0, 0, -6.0)]
    anchors = F.array(*(T.vec(x + a, y + b, z + c) for a, b, c in around), T.vec(x + 60, y, z))
    rows = s.select(F.col("s_suppkey").alias("sid"), T.vec(x + 1.5, y - 1, z + 2).alias("start"), anchors.alias("anchors"))
    return T.settled(rows, ["sid"], UNIT, cauchy=0.05).select("sid", *((F.round(a, 1) + F.lit(0.0)).alias(a) for a in "xyz"))


@query("t2_distance_residual", """WITH p AS (SELECT p_partkey AS pid, p_size / 10.0e0 AS len FROM part)
SELECT pid, round(CASE WHEN len < 1e-9 THEN 100.0e0 WHEN len >= 2 THEN len / 2 - 1 ELSE 2 / len - 1 END, 6) AS r FROM p""")
def t2(spark, sf):
    """The distance residual over pairs of points."""
    r = T.distance_residual(F.col("p_size") / 10.0, 2.0)
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("pid"), F.round(r, 6).alias("r"))


@query("t3_straight_residual", f"""WITH p AS (SELECT p_partkey AS pid, cos(p_size * {math.pi / 50!r}) AS cos FROM part)
SELECT pid, round(0.2e0 * (1 - cos) + 1.6e0 * greatest({COS30} - cos, 0) ** 2, 6) AS r FROM p""")
def t3(spark, sf):
    """Three points that turn by an angle of the part's size."""
    t = F.col("p_size") * (math.pi / 50)
    r = T.straight_residual(T.vec(-3, 0, 1), T.vec(0, 0, 1), T.vec(5 * F.cos(t), 5 * F.sin(t), 1))
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("pid"), F.round(r, 6).alias("r"))


@query("t4_dirichlet_residual", """WITH p AS (SELECT p_partkey AS pid, p_size / 10.0e0 AS a, p_partkey % 7 / 4.0e0 AS b, (1 + p_partkey % 5) / 2.0e0 AS c FROM part),
g AS (SELECT pid, (a * a + b * b + c * c) / 4 AS tr, (a * a * c * c) / 16 AS det FROM p) SELECT pid, round(tr + tr / greatest(det, 1e-9) - 4, 6) AS r FROM g""")
def t4(spark, sf):
    """Frames whose stretch follows from the part: a long and b, c across."""
    a, b, c = F.col("p_size") / 10.0, F.col("p_partkey") % 7 / 4.0, (1 + F.col("p_partkey") % 5) / 2.0
    r = T.dirichlet_residual(T.vec(1, 2, 3), T.vec(1 + a, 2, 3), T.vec(1 + b, 2 + c, 3), 2.0)
    return read_table(spark, sf, "part").select(F.col("p_partkey").alias("pid"), F.round(r, 6).alias("r"))


def _cells(spark, sf):
    """A patch of 3 x 3 cells of a plane for every part."""
    k = F.col("p_partkey")
    near = F.sequence(F.lit(1), F.lit(3))
    cells = read_table(spark, sf, "part").select(k.alias("gid"), "p_size", F.explode(near).alias("r")).withColumn("c", F.explode(near))
    k, r, c = F.col("gid"), F.col("r") * UNIT, F.col("c") * UNIT
    lean = k % 2 == 0
    return cells.select("gid", "r", "c", (F.col("p_size") + F.when(lean, 0.6 * c).otherwise(c)).alias("x"), (k % 97 + F.when(lean, 0.8 * c).otherwise(0.0)).alias("y"), (k % 13 + r).alias("z"))


PLANES = f"""SELECT p_partkey AS gid, CAST(i // {EDGE} AS INTEGER) AS r, CAST(i % {EDGE} AS INTEGER) AS c, round(p_size + CASE WHEN p_partkey % 2 = 0 THEN 6.0e0 ELSE 10.0e0 END * (i % {EDGE}), 3) AS x,
round(p_partkey % 97 + CASE WHEN p_partkey % 2 = 0 THEN 8.0e0 ELSE 0.0e0 END * (i % {EDGE}), 3) AS y, round(p_partkey % 13 + 10.0e0 * (i // {EDGE}), 3) AS z FROM part, range({EDGE * EDGE}) t(i)"""


def grown(spark, sf):
    out = T.grow(_cells(spark, sf), EDGE, EDGE, UNIT)
    return out.select("gid", "r", "c", *((F.round(a, 3) + F.lit(0.0)).alias(a) for a in "xyz"))


@query("t5_grow_grids", PLANES)
def t5(spark, sf):
    """The patch of every part grown to 5 x 5: planes are filled exactly."""
    return grown(spark, sf)


@query("t8_trace_to_surface", f"SELECT gid, r AS gy, c AS gx, z AS pz, y AS py, x AS px, 2.0e0 AS depth FROM ({PLANES})")
def t8(spark, sf):
    return T.to_surface(grown(spark, sf), 2.0, ["gid"])


def _tilted(spark, sf):
    """A signed distance whose zero set is the plane 0.8 y + 0.6 z = k; k follows from the parts."""
    k = read_table(spark, sf, "part").agg((12 + F.sum("p_size") % 5).alias("k"))
    return dense_grid(spark, N, N, N).join(F.broadcast(k)).select(*AXES, (0.8 * F.col("y") + 0.6 * F.col("z") - F.col("k")).alias("d"))


TILTED = "k AS (SELECT CAST(12 + sum(p_size) % 5 AS INTEGER) AS k FROM part)"


@query("t6_field_term", f"""WITH {TILTED}, p AS (SELECT p_partkey AS pid, p_partkey % 50 / 2.0e0 - 0.25e0 AS x, p_size / 2.0e0 AS y, p_partkey % 23 + 0.125e0 AS z FROM part),
q AS (SELECT *, x BETWEEN 0 AND {N - 1} AND y BETWEEN 0 AND {N - 1} AND z BETWEEN 0 AND {N - 1} AS ok FROM p, k)
SELECT pid, round(CASE WHEN ok THEN 0.8e0 * y + 0.6e0 * z - k ELSE 0 END, 6) AS f, 0.0e0 AS gx, CASE WHEN ok THEN 0.8e0 ELSE 0 END AS gy, CASE WHEN ok THEN 0.6e0 ELSE 0 END AS gz FROM q""")
def t6(spark, sf):
    """Value and gradient of a field at a point of every part; outside both are 0."""
    k = F.col("p_partkey")
    points = read_table(spark, sf, "part").select(k.alias("pid"), (k % 50 / 2.0 - 0.25).alias("x"), (F.col("p_size") / 2.0).alias("y"), (k % 23 + 0.125).alias("z"))
    seen = T.field_at(points, _tilted(spark, sf), (N, N, N), ["pid"])
    return seen.select("pid", (F.round("f", 6) + F.lit(0.0)).alias("f"), *((F.round(F.col("g")[a], 6) + F.lit(0.0)).alias(f"g{a}") for a in "xyz"))


@query("t7_seed_from_sdf", f"""WITH {TILTED}, s AS (SELECT s_suppkey AS gid, 8 + s_suppkey % 8 AS x, 9 + s_nationkey % 5 AS y, 8 + s_suppkey % 3 AS z FROM supplier),
p AS (SELECT gid, x, y - 0.8e0 * (0.8e0 * y + 0.6e0 * z - k) AS y, z - 0.6e0 * (0.8e0 * y + 0.6e0 * z - k) AS z FROM s, k)
SELECT gid, CAST(i // 3 AS INTEGER) AS r, CAST(i % 3 AS INTEGER) AS c, round(x + 2.0e0 * (i % 3 - 1), 4) AS x, round(y + 1.2e0 * (i // 3 - 1), 4) AS y, round(z - 1.6e0 * (i // 3 - 1), 4) AS z FROM p, range(9) t(i)""")
def t7(spark, sf):
    """A seed patch on the zero set near a start of every supplier."""
    k = F.col("s_suppkey")
    starts = read_table(spark, sf, "supplier").select(k.alias("gid"), (8 + k % 8).cast("double").alias("x"), (9 + F.col("s_nationkey") % 5).cast("double").alias("y"), (8 + k % 3).cast("double").alias("z"))
    out = T.seed_patches(starts, _tilted(spark, sf), (N, N, N), 2.0)
    return out.select("gid", "r", "c", *((F.round(a, 4) + F.lit(0.0)).alias(a) for a in "xyz"))


@query("t10_trace_pipeline")
def t10(spark, sf):
    """Detect, signed distance, seed and grow: a grid a supplier on the sheet of a noisy volume."""
    dims = (20, 20, 20)
    found = P.remove_small(P.detect_sheets(_noisy_sheet(spark, sf, dims), dims, value_low=80), 20, 20, 50)
    field = P.materialize(P.signed_distance(found, dims), "sdf")
    starts = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("gid"), (9 + F.col("s_suppkey") % 3).cast("double").alias("x"), (9 + F.col("s_nationkey") % 3).cast("double").alias("y"), F.lit(12.0).alias("z"))
    seeds = T.seed_patches(starts, field, dims, 3.0, 3, (1, 1))
    return T.grow(seeds, 5, 5, 3.0, T.Growth(), field, dims)

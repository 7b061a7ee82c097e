"""Planes, quads and meshes as tables of points."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sample import unit

POINT = ("pz", "py", "px")
NORMAL = ("nz", "ny", "nx")


def cross(a, b) -> tuple[float, float, float]:
    """Cross product on the stored (z, y, x) order."""
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def plane_basis(normal):
    """(n, u, v): unit normal and two in-plane axes; the seed is the axis least aligned with n, ties in z, y, x order."""
    n = unit(normal)
    seed = min(range(3), key=lambda k: (abs(n[k]), k))
    u = unit(cross(n, [float(k == seed) for k in range(3)]))
    return n, u, unit(cross(n, u))


def plane_points(spark, origin, normal, w: int, h: int, scale: float) -> DataFrame:
    """(i, j, point, normal) of a w x h image on a plane, centred on the origin."""
    n, u, v = plane_basis(normal)
    rows = spark.range(w * h).select(F.expr(f"id DIV {w}").cast("int").alias("i"), (F.col("id") % w).cast("int").alias("j"))
    du, dv = (F.col("j") - w * 0.5) * scale, (F.col("i") - h * 0.5) * scale
    points = [(F.lit(float(origin[k])) + du * u[k] + dv * v[k]).alias(c) for k, c in enumerate(POINT)]
    return rows.select("i", "j", *points, *(F.lit(n[k]).alias(c) for k, c in enumerate(NORMAL)))


def quad_points(grid: DataFrame, gw: int, gh: int, x0: float, y0: float, step: float, w: int, h: int) -> DataFrame:
    """(i, j, point, normal): bilinear over control points (gy, gx, pz, py, px); outside or beside an invalid point, nulls.

    Pixels find the four corners of their cell by equi-joins; du x dv is the normal.
    """
    spark = grid.sparkSession
    rows = spark.range(w * h).select(F.expr(f"id DIV {w}").cast("int").alias("i"), (F.col("id") % w).cast("int").alias("j"))
    rows = rows.withColumns({"_y": F.lit(float(y0)) + F.col("i") * float(step), "_x": F.lit(float(x0)) + F.col("j") * float(step)})
    inside = F.col("_y").between(0, gh - 1) & F.col("_x").between(0, gw - 1)
    rows = rows.withColumns({"gy": F.when(inside, F.greatest(F.least(F.floor("_y"), F.lit(gh - 2)), F.lit(0))).cast("int"), "gx": F.when(inside, F.greatest(F.least(F.floor("_x"), F.lit(gw - 2)), F.lit(0))).cast("int")})
    # One row a cell with its four corners: each control point is sent to the cells that it bounds.
    sent = grid.where("pz IS NOT NULL").select(*POINT, F.explode(F.array(*(F.struct((F.col("gy") - dy).alias("gy"), (F.col("gx") - dx).alias("gx"), F.lit(2 * dy + dx).alias("k")) for dy in (0, 1) for dx in (0, 1)))).alias("c"))
    sent = sent.select("c.*", *POINT)
    cells = sent.groupBy("gy", "gx").agg(F.count(F.lit(1)).alias("_n"), *(F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for k in range(4) for c in POINT)).where("_n = 4")
    joined = rows.join(cells, ["gy", "gx"], "left")
    fy, fx = F.col("_y") - F.col("gy"), F.col("_x") - F.col("gx")
    out, du, dv = {}, [], []
    for c in POINT:
        p = [F.col(f"{c}{k}") for k in range(4)]
        left, right = p[0] + (p[2] - p[0]) * fy, p[1] + (p[3] - p[1]) * fy
        out[c] = left + (right - left) * fx
        du.append((p[1] - p[0]) * (1.0 - fy) + (p[3] - p[2]) * fy)
        first, second = p[2] - p[0], p[3] - p[1]
        dv.append(first + (second - first) * fx)
    n = cross(du, dv)
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return joined.select("i", "j", *(e.alias(c) for c, e in out.items()), *(F.when(size > 1e-12, e / size).otherwise(e).alias(c) for c, e in zip(NORMAL, n, strict=True)))


def rescale(grid: DataFrame, factor: float) -> DataFrame:
    """Scaled coordinates and depth; invalid points stay invalid."""
    return grid.withColumns({c: F.col(c) * float(factor) for c in (*POINT, "depth")})


def principal_axes(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two axes of largest spread of a symmetric 3x3 matrix; the first nonzero component is positive."""
    _, vectors = np.linalg.eigh(cov)
    axes = []
    for k in (2, 1):
        v = vectors[:, k]
        lead = v[np.flatnonzero(np.abs(v) > 1e-9)[0]]
        axes.append(v if lead > 0 else -v)
    return axes[0], axes[1]


def grid_from_mesh(vertices: DataFrame, gw: int = 0, gh: int = 0, depth: float = 0.0) -> DataFrame:
    """(gy, gx, pz, py, px, depth): a grid over the best-fit plane of vertices (vid, x, y, z), each cell at the nearest one.

    The nearest vertex lies within sqrt(2.5) cells, so cells and vertices meet by an equality on
    square buckets within two of each other; ties go to the smaller vid. Cells without one are null.
    """
    from .aggregate import covariance

    spark = vertices.sparkSession
    nv = vertices.count()
    if nv < 3:
        raise ValueError("a plane needs three vertices")
    row = covariance(vertices).first()
    cov = np.array([[row["sxx"], row["sxy"], row["sxz"]], [row["sxy"], row["syy"], row["syz"]], [row["sxz"], row["syz"], row["szz"]]])
    u, v = principal_axes(cov)
    d = [F.col(c) - float(row[f"m{c}"]) for c in ("x", "y", "z")]
    flat = vertices.select("vid", "x", "y", "z", sum(d[k] * float(u[k]) for k in range(3)).alias("u"), sum(d[k] * float(v[k]) for k in range(3)).alias("w"))
    ext = flat.agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("w").alias("w0"), F.max("w").alias("w1")).first()
    if gw <= 0 or gh <= 0:
        gw = gh = max(8, int(1.5 * math.sqrt(nv)))
    du, dv = (ext["u1"] - ext["u0"]) / max(gw - 1, 1) or 1.0, (ext["w1"] - ext["w0"]) / max(gh - 1, 1) or 1.0
    size = min(du, dv)

    def bucket(value, start):
        return F.floor((value - float(start)) / size).cast("int")

    cells = spark.range(gw * gh).select(F.expr(f"id DIV {gw}").cast("int").alias("gy"), (F.col("id") % gw).cast("int").alias("gx"))
    cells = cells.withColumns({"tu": F.col("gx") * du + float(ext["u0"]), "tw": F.col("gy") * dv + float(ext["w0"])})
    near = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3)))
    asked = cells.withColumn("o", F.explode(near)).select("gy", "gx", "tu", "tw", (bucket(F.col("tu"), ext["u0"]) + F.col("o.a")).alias("bu"), (bucket(F.col("tw"), ext["w0"]) + F.col("o.b")).alias("bw"))
    put = flat.select("vid", "x", "y", "z", "u", "w", bucket(F.col("u"), ext["u0"]).alias("bu"), bucket(F.col("w"), ext["w0"]).alias("bw"))
    d2 = (F.col("u") - F.col("tu")) ** 2 + (F.col("w") - F.col("tw")) ** 2
    best = asked.join(put, ["bu", "bw"]).withColumn("d2", d2).where(F.col("d2") < 2.5 * size * size).groupBy("gy", "gx").agg(F.min(F.struct("d2", "vid", "z", "y", "x")).alias("b"))
    out = cells.select("gy", "gx").join(best, ["gy", "gx"], "left")
    return out.select("gy", "gx", F.col("b.z").alias("pz"), F.col("b.y").alias("py"), F.col("b.x").alias("px"), F.when(F.col("b.vid").isNotNull(), F.lit(float(depth))).otherwise(F.lit(0.0)).alias("depth"))


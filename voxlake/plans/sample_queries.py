"""Queries of sampling and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import geometry as M
from ..operators import sample as J
from ..operators import volume as V
from ..sources.volumes import read_table, vox, vox_sql
from .register import query
from .volume_queries import SURFACE, surface, surface_height

VOX32, VOX64 = f"WITH vox AS ({vox_sql(32)})", f"WITH vox AS ({vox_sql(64)})"
POINTS = "points AS (SELECT o_orderkey AS pid, (o_orderkey * 13 % 640) / 20.0e0 - 0.5e0 AS pz, (o_custkey * 7 % 640) / 20.0e0 AS py, ((o_orderkey * 3 + o_custkey) % 640) / 20.0e0 AS px FROM orders)"


def points(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read_table(spark, sf, "orders").select(k.alias("pid"), ((k * 13 % 640) / 20.0 - 0.5).alias("pz"), ((c * 7 % 640) / 20.0).alias("py"), (((k * 3 + c) % 640) / 20.0).alias("px"))


def nearest_sql(extra=""):
    return f"""SELECT pid{extra}, CAST(coalesce(v, 0) AS DOUBLE) AS f FROM points LEFT JOIN vox ON pz >= 0 AND vox.z = floor(pz + 0.5) AND vox.y = floor(py + 0.5) AND vox.x = floor(px + 0.5)"""


CORNERS = """c8 AS (SELECT pid, CASE WHEN pz >= 0 THEN CAST(floor(pz) AS INTEGER) + dz ELSE -1 END AS z, CAST(floor(py) AS INTEGER) + dy AS y, CAST(floor(px) AS INTEGER) + dx AS x, 4 * dz + 2 * dy + dx AS k,
  CASE WHEN dz = 1 THEN pz - floor(pz) ELSE 1 - (pz - floor(pz)) END * CASE WHEN dy = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END * CASE WHEN dx = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END AS w
  FROM points, (SELECT i // 4 AS dz, i // 2 % 2 AS dy, i % 2 AS dx FROM range(8) t(i)))"""
#: The eight terms in the order of the corners, as in the operator: a sum of doubles depends on its order.
EIGHT = " + ".join(f"coalesce(sum(w * coalesce(v, 0)) FILTER (k = {k}), 0e0)" for k in range(8))
TRI = f"tri AS (SELECT pid, {EIGHT} AS f FROM c8 LEFT JOIN vox USING (z, y, x) GROUP BY pid)"


@query("j1_sample_nearest", f"{VOX32}, {POINTS} {nearest_sql()}")
def j1(spark, sf):
    return J.sample(points(spark, sf), vox(spark, sf), ["pid"], trilinear=False)


@query("j2_sample_trilinear", f"{VOX32}, {POINTS}, {CORNERS}, {TRI} SELECT pid, round(CAST(f AS DOUBLE), 6) AS f FROM tri")
def j2(spark, sf):
    """Coordinates are twentieths, so values are multiples of 1 / 8000: six digits hold them, and none lies between two roundings."""
    return J.sample(points(spark, sf), vox(spark, sf), ["pid"]).withColumn("f", F.round("f", 6))


@query("j3_sample_batch_u8", f"{VOX32}, {POINTS}, {CORNERS}, {TRI} SELECT pid, CAST(floor(least(greatest(round(CAST(f AS DOUBLE), 6), 0), 255) + 0.5) AS INTEGER) AS f FROM tri")
def j3(spark, sf):
    return J.as_u8(J.sample(points(spark, sf), vox(spark, sf), ["pid"]).withColumn("f", F.round("f", 6)))


def levels_sql():
    parts, last = [], "vox"
    for k in (1, 2):
        parts.append(f"""l{k} AS (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, (CAST(sum(v) AS BIGINT) + count(*) // 2) // count(*) AS v FROM {last} WHERE v > 0 GROUP BY 1, 2, 3)""")
        last = f"l{k}"
    return f"""{", ".join(parts)}, levels AS (SELECT 0 AS lod, z, y, x, v FROM vox WHERE v > 0 UNION ALL SELECT 1, z, y, x, v FROM l1 UNION ALL SELECT 2, z, y, x, v FROM l2),
resident AS (SELECT DISTINCT lod, z // 4 AS bz, y // 4 AS by_, x // 4 AS bx FROM levels WHERE (z // 4 + y // 4 + x // 4) % (3 - lod) = 0 AND NOT (lod = 2 AND z // 4 = 0))"""


def levels(spark, sf):
    return A.pyramid(vox(spark, sf), 32, 8)


def resident(lv):
    b = V.with_cells(lv, "b", 4)
    return b.where((F.expr("(bz + by + bx) % (3 - lod)") == 0) & ~((F.col("lod") == 2) & (F.col("bz") == 0))).select("lod", "bz", "by", "bx").distinct()


@query("j7_lod_fallback", f"""{VOX32}, {POINTS}, {levels_sql()},
e AS (SELECT pid, lod, (pz + 0.5) / (1 << lod) - 0.5 AS pz, (py + 0.5) / (1 << lod) - 0.5 AS py, (px + 0.5) / (1 << lod) - 0.5 AS px FROM points, (SELECT unnest([0, 1, 2]) AS lod) t),
h AS (SELECT e.* FROM e SEMI JOIN resident r ON r.lod = e.lod AND r.bz = CAST(greatest(floor(pz), 0) AS INTEGER) // 4 AND r.by_ = CAST(greatest(floor(py), 0) AS INTEGER) // 4 AND r.bx = CAST(greatest(floor(px), 0) AS INTEGER) // 4),
b AS (SELECT pid, min(lod) AS lod, arg_min(pz, lod) AS pz, arg_min(py, lod) AS py, arg_min(px, lod) AS px FROM h GROUP BY pid)
SELECT p.pid, CAST(b.lod AS INTEGER) AS lod, CAST(coalesce(v, 0) AS DOUBLE) AS f FROM points p LEFT JOIN b USING (pid) LEFT JOIN levels l ON l.lod = b.lod AND l.z = floor(greatest(b.pz, 0) + 0.5) AND l.y = floor(greatest(b.py, 0) + 0.5) AND l.x = floor(greatest(b.px, 0) + 0.5)""")
def j7(spark, sf):
    lv = levels(spark, sf)
    return J.lod_fallback(points(spark, sf), lv, resident(lv), ["pid"], 3, 4)


@query("j7_trilinear_fallback", f"""{VOX32}, {POINTS}, {levels_sql()},
e AS (SELECT pid, lod, (pz + 0.5) / (1 << lod) - 0.5 AS pz, (py + 0.5) / (1 << lod) - 0.5 AS py, (px + 0.5) / (1 << lod) - 0.5 AS px FROM points, (SELECT unnest([0, 1, 2]) AS lod) t),
h AS (SELECT e.* FROM e SEMI JOIN resident r ON r.lod = e.lod AND r.bz = CAST(greatest(floor(pz), 0) AS INTEGER) // 4 AND r.by_ = CAST(greatest(floor(py), 0) AS INTEGER) // 4 AND r.bx = CAST(greatest(floor(px), 0) AS INTEGER) // 4),
b AS (SELECT pid, min(lod) AS lod, arg_min(pz, lod) AS pz, arg_min(py, lod) AS py, arg_min(px, lod) AS px FROM h GROUP BY pid),
t AS (SELECT pid, lod, greatest(pz, 0) AS pz, greatest(py, 0) AS py, greatest(px, 0) AS px FROM b),
c AS (SELECT t.pid, t.lod, abs(1 - dz - (pz - floor(pz))) * abs(1 - dy - (py - floor(py))) * abs(1 - dx - (px - floor(px))) AS w, floor(pz) + dz AS z, floor(py) + dy AS y, floor(px) + dx AS x
  FROM t, (SELECT i // 4 AS dz, i // 2 % 2 AS dy, i % 2 AS dx FROM range(8) r(i))),
s AS (SELECT pid, c.lod, sum(w * coalesce(v, 0)) AS f FROM c LEFT JOIN levels l ON l.lod = c.lod AND l.z = c.z AND l.y = c.y AND l.x = c.x GROUP BY 1, 2)
SELECT p.pid, CAST(s.lod AS INTEGER) AS lod, round(CAST(coalesce(f, 0) AS DOUBLE) + 1e-8, 6) AS f FROM points p LEFT JOIN s USING (pid)""")
def j7_trilinear(spark, sf):
    lv = levels(spark, sf)
    return J.lod_fallback(points(spark, sf), lv, resident(lv), ["pid"], 3, 4, trilinear=True).withColumn("f", F.round(F.col("f") + 1e-8, 6))  # many values lie halfway between two of six digits


@query("j8_best_lod", f"""{VOX32}, {levels_sql()}, b AS (SELECT DISTINCT CAST(z // 4 AS INTEGER) AS z0, CAST(y // 4 AS INTEGER) AS y0, CAST(x // 4 AS INTEGER) AS x0 FROM vox)
SELECT z0, y0, x0, CAST(coalesce(min(r.lod), -1) AS INTEGER) AS lod FROM b LEFT JOIN resident r ON r.bz = z0 >> r.lod AND r.by_ = y0 >> r.lod AND r.bx = x0 >> r.lod GROUP BY z0, y0, x0""")
def j8(spark, sf):
    blocks = V.with_cells(vox(spark, sf), "b", 4).select("bz", "by", "bx").distinct()
    keyed = blocks.select(F.col("bz").alias("z0"), F.col("by").alias("y0"), F.col("bx").alias("x0"), "bz", "by", "bx")
    return J.best_lod(keyed, resident(levels(spark, sf)), ["z0", "y0", "x0"], 3)


@query("j9_oriented_box", f"""{VOX32}, points AS (SELECT i AS pid, 4.5 + (i % 12) * 0.5 + (i // 144) * 0.75 AS pz, 3.25 + (i // 12 % 12) * 1.5 AS py, 2 + (i % 12) * 1.25 + (i // 144) * 0.25 AS px FROM range(1152) t(i)), {CORNERS}, {TRI}
SELECT CAST(pid // 144 AS INTEGER) AS k, CAST(pid // 12 % 12 AS INTEGER) AS i, CAST(pid % 12 AS INTEGER) AS j, round(CAST(f AS DOUBLE), 4) AS f FROM tri""")
def j9(spark, sf):
    at = J.box_points(spark, (4.5, 3.25, 2.0), (0.5, 0.0, 1.25), (0.0, 1.5, 0.0), (0.75, 0.0, 0.25), 12, 12, 8)
    return J.sample(at, vox(spark, sf), ["k", "i", "j"]).withColumn("f", F.round("f", 4))


QUAD = f"""{SURFACE}, px_ AS (SELECT i // 36 AS i, i % 36 AS j, 0.25e0 + (i // 36) * 0.5e0 AS gy_, 0.5e0 + (i % 36) * 0.5e0 AS gx_ FROM (SELECT unnest(range(36 * 2 * h)) AS i FROM dim)),
cell AS (SELECT *, CASE WHEN gy_ BETWEEN 0 AND h - 1 AND gx_ BETWEEN 0 AND 39 THEN least(CAST(floor(gy_) AS INTEGER), h - 2) END AS cy, CASE WHEN gy_ BETWEEN 0 AND h - 1 AND gx_ BETWEEN 0 AND 39 THEN least(CAST(floor(gx_) AS INTEGER), 38) END AS cx FROM px_, dim),
four AS (SELECT i, j, gy_ - cy AS fy, gx_ - cx AS fx, {", ".join(f"{n}.{c} AS {c}{k}" for k, n in enumerate("abcd") for c in ("pz", "py", "px"))} FROM cell
  LEFT JOIN grid a ON a.gy = cy AND a.gx = cx LEFT JOIN grid b ON b.gy = cy AND b.gx = cx + 1 LEFT JOIN grid c ON c.gy = cy + 1 AND c.gx = cx LEFT JOIN grid d ON d.gy = cy + 1 AND d.gx = cx + 1),
quad AS (SELECT i, j, {", ".join(f"({c}0 + ({c}2 - {c}0) * fy) + (({c}1 + ({c}3 - {c}1) * fy) - ({c}0 + ({c}2 - {c}0) * fy)) * fx AS {c}" for c in ("pz", "py", "px"))},
  {", ".join(f"({c}1 - {c}0) * (1 - fy) + ({c}3 - {c}2) * fy AS du{c[1]}, ({c}2 - {c}0) + (({c}3 - {c}1) - ({c}2 - {c}0)) * fx AS dv{c[1]}" for c in ("pz", "py", "px"))} FROM four),
crossed AS (SELECT i, j, pz, py, px, duy * dvx - dux * dvy AS mz, dux * dvz - duz * dvx AS my, duz * dvy - duy * dvz AS mx FROM quad),
normals AS (SELECT i, j, pz, py, px, mz / sqrt(mz * mz + my * my + mx * mx) AS nz, my / sqrt(mz * mz + my * my + mx * mx) AS ny, mx / sqrt(mz * mz + my * my + mx * mx) AS nx FROM crossed)"""


def quad(spark, sf):
    """Pixels half a control point apart, over all rows of the surface."""
    height = surface_height(spark, sf)
    return M.quad_points(surface(spark, sf), 40, height, 0.5, 0.25, 0.5, 36, 2 * height)


@query("m2_quad_points", f"""WITH {QUAD} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {", ".join(f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in ("pz", "py", "px", "nz", "ny", "nx"))} FROM normals""")
def m2(spark, sf):
    return quad(spark, sf).select("i", "j", *(F.round(c, 4).alias(c) for c in (*M.POINT, *M.NORMAL)))


@query("j10_surface_volume", f"""{VOX32}, {QUAD}, points AS (SELECT (i * 100 + j) * 10 + k AS pid, coalesce(pz + (k - 2) * nz, -1) AS pz, coalesce(py + (k - 2) * ny, 0) AS py, coalesce(px + (k - 2) * nx, 0) AS px, k, i, j, pz IS NOT NULL AND least(pz + (k - 2) * nz, py + (k - 2) * ny, px + (k - 2) * nx) >= 0 AS ok FROM normals, range(5) t(k)),
{CORNERS.replace("pz >= 0 THEN", "ok THEN")}, {TRI} SELECT CAST(k AS INTEGER) AS k, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(CAST(coalesce(f, 0) AS DOUBLE), 3) AS f FROM points LEFT JOIN tri USING (pid)""")
def j10(spark, sf):
    q = quad(spark, sf).withColumn("k", F.explode(F.array(*map(F.lit, range(5)))))
    at = q.select("k", "i", "j", *((F.col(f"p{a}") + (F.col("k") - 2) * F.col(f"n{a}")).alias(f"p{a}") for a in "zyx"))
    return J.sample(at, vox(spark, sf), ["k", "i", "j"]).withColumn("f", F.round("f", 3))


@query("m1_plane_basis", """WITH b AS (SELECT 1 / sqrt(14e0) AS a, 2 / sqrt(14e0) AS b, 3 / sqrt(14e0) AS c)
SELECT round(a, 6) AS nz, round(b, 6) AS ny, round(c, 6) AS nx, 0.0e0 AS uz, round(c / sqrt(b * b + c * c), 6) AS uy, round(-b / sqrt(b * b + c * c), 6) AS ux,
  round((b * (-b) - c * c) / sqrt(b * b + c * c), 6) AS vz, round(a * b / sqrt(b * b + c * c), 6) AS vy, round(a * c / sqrt(b * b + c * c), 6) AS vx FROM b""")
def m1(spark, sf):
    n, u, v = M.plane_basis((1, 2, 3))
    return spark.range(1).select(*(F.round(F.lit(vec[k]), 6).alias(f"{p}{a}") for p, vec in (("n", n), ("u", u), ("v", v)) for k, a in enumerate("zyx")))


@query("m1_plane_points", """SELECT CAST(i // 20 AS INTEGER) AS i, CAST(i % 20 AS INTEGER) AS j, 16.0e0 AS pz, 16 - (i // 20 - 8) * 0.75e0 AS py, 16 + (i % 20 - 10) * 0.75e0 AS px FROM range(320) t(i)""")
def m1b(spark, sf):
    return M.plane_points(spark, (16, 16, 16), (1, 0, 0), 20, 16, 0.75).select("i", "j", F.col("pz") + F.lit(0.0), "py", "px").toDF("i", "j", "pz", "py", "px")


@query("m3_pick_lod", "SELECT * FROM (VALUES (0.5e0, 0), (1.9e0, 0), (2.0e0, 1), (5.0e0, 2), (100.0e0, 4)) t(vox_per_pixel, lod)")
def m3(spark, sf):
    rows = [(v, J.pick_lod(v, 5)) for v in (0.5, 1.9, 2.0, 5.0, 100.0)]
    return spark.createDataFrame(rows, "vox_per_pixel double, lod int")


@query("m5_grid_from_mesh", """WITH v AS (SELECT p_partkey AS vid, (p_partkey % 23) * 1.0e0 + p_size / 100.0e0 AS x, (p_partkey % 17) * 0.7e0 AS y FROM part),
m AS (SELECT avg(x) AS mx, avg(y) AS my FROM v), f AS (SELECT vid, x, y, x - mx AS dx, y - my AS dy FROM v, m),
s AS (SELECT sum(dx * dx) AS a, sum(dx * dy) AS b, sum(dy * dy) AS c FROM f), g AS (SELECT atan2(2 * b, a - c) / 2 AS th FROM s),
ax AS (SELECT cos(th) AS ux, sin(th) AS uy, CASE WHEN sin(th) < 0 THEN -sin(th) ELSE sin(th) END AS wx, CASE WHEN sin(th) < 0 THEN cos(th) ELSE -cos(th) END AS wy FROM g),
p AS (SELECT vid, x, y, dx * ux + dy * uy AS u, dx * wx + dy * wy AS w FROM f, ax), e AS (SELECT min(u) AS u0, max(u) AS u1, min(w) AS w0, max(w) AS w1 FROM p),
c AS (SELECT i // 12 AS gy, i % 12 AS gx, u0 + (i % 12) * (u1 - u0) / 11 AS tu, w0 + (i // 12) * (w1 - w0) / 9 AS tw, least((u1 - u0) / 11, (w1 - w0) / 9) AS cell FROM range(120) t(i), e),
n AS (SELECT gy, gx, p.vid, p.x, p.y, row_number() OVER (PARTITION BY gy, gx ORDER BY (u - tu) ** 2 + (w - tw) ** 2, p.vid) AS k FROM c JOIN p ON (u - tu) ** 2 + (w - tw) ** 2 < 2.5 * cell * cell)
SELECT CAST(c.gy AS INTEGER) AS gy, CAST(c.gx AS INTEGER) AS gx, CASE WHEN n.vid IS NOT NULL THEN 2.5e0 END AS pz, n.y AS py, n.x AS px, CASE WHEN n.vid IS NOT NULL THEN 4.0e0 ELSE 0.0e0 END AS depth
FROM c LEFT JOIN n ON n.gy = c.gy AND n.gx = c.gx AND n.k = 1""")
def m5(spark, sf):
    k = F.col("p_partkey")
    v = read_table(spark, sf, "part").select(k.alias("vid"), ((k % 23) * 1.0 + F.col("p_size") / 100.0).alias("x"), ((k % 17) * 0.7).alias("y"), F.lit(2.5).alias("z"))
    return M.grid_from_mesh(v, 12, 10, 4.0)


@query("m6_rescale", f"WITH {SURFACE} SELECT gy, gx, CAST(pz * 2 AS DOUBLE) AS pz, CAST(py * 2 AS DOUBLE) AS py, CAST(px * 2 AS DOUBLE) AS px, round(CAST(depth * 2 AS DOUBLE), 4) AS depth FROM grid")
def m6(spark, sf):
    return M.rescale(surface(spark, sf), 2.0).withColumn("depth", F.round("depth", 4))

"""Queries of compositing and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composite as N
from ..operators import geometry as M
from ..operators import shaded as S
from ..operators.sample import lod_fallback, pick_lod
from ..functions.coords import to_u8
from ..sources.volumes import vox, vox_sql
from .register import query
from .sample_queries import CORNERS, QUAD, TRI, levels, levels_sql, quad, resident

W, H, STEPS = 20, 16, 17
VOX32 = f"WITH vox AS ({vox_sql(32)})"
PIXELS = f"pixels AS (SELECT i // {W} AS i, i % {W} AS j, 16.0e0 AS pz, 16 - (i // {W} - {H // 2}) * 0.75e0 AS py, 16 + (i % {W} - {W // 2}) * 0.75e0 AS px FROM range({W * H}) t(i))"


def rays_sql(scale="", steps=STEPS, t0="-4", dt="0.5e0"):
    return f"""{PIXELS}, points AS (SELECT (i * {W} + j) * 100 + s AS pid, pz + ({t0} + s * {dt}) AS pz, py, px FROM pixels, range({steps}) r(s)), {CORNERS}, {TRI},
rays AS (SELECT CAST(pid // 100 // {W} AS INTEGER) AS i, CAST(pid // 100 % {W} AS INTEGER) AS j, CAST(pid % 100 AS INTEGER) AS step, CAST(f AS DOUBLE) AS v FROM tri)"""


def u8(e):
    return f"CAST(floor(least(greatest({e}, 0), 255) + 0.5) AS INTEGER)"


def pixels(spark):
    return M.plane_points(spark, (16, 16, 16), (1, 0, 0), W, H, 0.75)


def rays(spark, sf):
    return N.ray_samples(vox(spark, sf), pixels(spark), -4, 4, 0.5)


def _mode(name, mode, value, **params):
    @query(name, f"{VOX32}, {rays_sql()} SELECT i, j, {value} AS val FROM rays GROUP BY i, j")
    def run(spark, sf):
        return N.composite(rays(spark, sf), mode, STEPS, **params)

    return run


_mode("n1_composite_min", "min", u8("min(v)"))
_mode("n2_composite_max", "max", u8("max(v)"))
_mode("n3_composite_mean", "mean", u8("sum(v) / count(v)"))
_mode("n4_composite_stddev", "stddev", u8("sqrt(greatest(sum(v * v) / count(v) - (sum(v) / count(v)) * (sum(v) / count(v)), 0.0))"))
_mode("n6_composite_percentile", "percentile", u8("list_sort(list(v))[CAST(floor(0.9e0 * (count(*) - 1) + 0.5) AS BIGINT) + 1]"))
_mode("n7_composite_depth", "depth", f"CAST(coalesce(floor(1.0 + 254.0e0 * (min(step) FILTER (v / 255.0e0 > 0.3e0) / {STEPS - 1}.0e0) + 0.5), 0) AS INTEGER)", alpha_min=0.3)
_mode("n5_composite_alpha", "alpha", u8("""list_reduce(list({'acc': v, 'op': 0.0e0} ORDER BY step), lambda s, x: CASE WHEN s.op >= 0.98e0 THEN s ELSE
  {'acc': s.acc + (1.0e0 - s.op) * least(greatest((x.acc / 255.0e0 - 0.1e0) * (0.6e0 / (1.0e0 - 0.1e0)), 0.0e0), 1.0e0) * x.acc, 'op': s.op + (1.0e0 - s.op) * least(greatest((x.acc / 255.0e0 - 0.1e0) * (0.6e0 / (1.0e0 - 0.1e0)), 0.0e0), 1.0e0)} END, {'acc': 0.0e0, 'op': 0.0e0}).acc"""), alpha_min=0.1, opacity=0.6)


@query("n0_render_slice", f"{VOX32}, {rays_sql(steps=1, t0='0')} SELECT i, j, {u8('v')} AS val FROM rays")
def n0(spark, sf):
    return N.render(vox(spark, sf), pixels(spark), "none")


@query("n11_render_plane_max", f"{VOX32}, {rays_sql()} SELECT i, j, {u8('max(v)')} AS val FROM rays GROUP BY i, j")
def n11(spark, sf):
    return N.render(vox(spark, sf), pixels(spark), "max", -4, 4, 0.5)


@query("n11_render_quad_max", f"""{VOX32}, {QUAD}, points AS (SELECT (i * 100 + j) * 10 + k AS pid, coalesce(pz + (k - 2) * nz, -1) AS pz, coalesce(py + (k - 2) * ny, 0) AS py, coalesce(px + (k - 2) * nx, 0) AS px, pz IS NOT NULL AND least(pz + (k - 2) * nz, py + (k - 2) * ny, px + (k - 2) * nx) >= 0 AS ok FROM normals, range(5) t(k)),
{CORNERS.replace("pz >= 0 THEN", "ok THEN")}, {TRI} SELECT CAST(pid // 1000 AS INTEGER) AS i, CAST(pid // 10 % 100 AS INTEGER) AS j, {u8("max(coalesce(f, 0))")} AS val FROM points LEFT JOIN tri USING (pid) GROUP BY 1, 2""")
def n11q(spark, sf):
    return N.render(vox(spark, sf), quad(spark, sf), "max", -2, 2, 1.0)


@query("n12_render_plane_lod", f"""{VOX32}, l1 AS (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, (CAST(sum(v) AS BIGINT) + count(*) // 2) // count(*) AS v FROM vox WHERE v > 0 GROUP BY 1, 2, 3),
at0 AS (SELECT i // {W} AS i, i % {W} AS j, 16.0e0 AS pz, 16 - (i // {W} - {H // 2}) * 2.0e0 AS py, 16 + (i % {W} - {W // 2}) * 2.0e0 AS px FROM range({W * H}) t(i)),
points AS (SELECT (i * {W} + j) * 100 + s AS pid, greatest((pz + 0.5) * 0.5 - 0.5, 0) + (-2 + s) AS pz, greatest((py + 0.5) * 0.5 - 0.5, 0) AS py, greatest((px + 0.5) * 0.5 - 0.5, 0) AS px FROM at0, range(5) r(s)), {CORNERS}, {TRI.replace("vox USING", "l1 USING")}
SELECT CAST(pid // 100 // {W} AS INTEGER) AS i, CAST(pid // 100 % {W} AS INTEGER) AS j, {u8("max(f)")} AS val FROM tri GROUP BY 1, 2""")
def n12(spark, sf):
    lod = pick_lod(2.0, 3)
    at, t0, t1 = N.lod_matched(M.plane_points(spark, (16, 16, 16), (1, 0, 0), W, H, 2.0), lod, -4, 4)
    return N.render(levels(spark, sf).where(F.col("lod") == lod).drop("lod"), at, "max", t0, t1, 1.0)


@query("n13_render_lod_fallback", f"""{VOX32}, {PIXELS}, {levels_sql()},
e AS (SELECT i, j, lod, (pz + 0.5) / (1 << lod) - 0.5 AS pz, (py + 0.5) / (1 << lod) - 0.5 AS py, (px + 0.5) / (1 << lod) - 0.5 AS px FROM pixels, (SELECT unnest([0, 1, 2]) AS lod) t),
h AS (SELECT e.* FROM e SEMI JOIN resident r ON r.lod = e.lod AND r.bz = CAST(greatest(floor(pz), 0) AS INTEGER) // 4 AND r.by_ = CAST(greatest(floor(py), 0) AS INTEGER) // 4 AND r.bx = CAST(greatest(floor(px), 0) AS INTEGER) // 4),
b AS (SELECT i, j, min(lod) AS lod, arg_min(pz, lod) AS pz, arg_min(py, lod) AS py, arg_min(px, lod) AS px FROM h GROUP BY i, j)
SELECT CAST(p.i AS INTEGER) AS i, CAST(p.j AS INTEGER) AS j, CAST(coalesce(v, 0) AS INTEGER) AS val FROM pixels p LEFT JOIN b USING (i, j) LEFT JOIN levels l ON l.lod = b.lod AND l.z = floor(greatest(b.pz, 0) + 0.5) AND l.y = floor(greatest(b.py, 0) + 0.5) AND l.x = floor(greatest(b.px, 0) + 0.5)""")
def n13(spark, sf):
    lv = levels(spark, sf)
    return lod_fallback(pixels(spark), lv, resident(lv), ["i", "j"], 3, 4).select("i", "j", to_u8(F.col("f")).alias("val"))


@query("n8_render_shaded")
def n8(spark, sf):
    return S.render_shaded(vox(spark, sf), pixels(spark), S.Shading(light=(-1, -1, 0), shadow=0.5, glow=0.3, curvature=0.4), tile=16, brick=16)


@query("n9_render_ink")
def n9(spark, sf):
    return S.render_shaded(vox(spark, sf), pixels(spark), S.Shading(ink=True, lock=3.0, absorption=0.3), tile=16, brick=16)


@query("n10_render_surface_light")
def n10(spark, sf):
    return S.render_shaded(vox(spark, sf), quad(spark, sf), S.Shading(light=(0.3, 0, 1), surface_light=True), tile=16, brick=16)



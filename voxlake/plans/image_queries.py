"""Queries of image operators; the image is the part table laid out as 40 columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.coords import dense_grid
from ..operators import composite as N
from ..operators import geometry as M
from ..operators import image as I
from ..sources.volumes import read_table, vox, vox_sql
from .register import query
from .render_queries import u8
from .volume_queries import surface_height

IMAGE = """img AS (SELECT CAST(p_partkey // 40 AS INTEGER) AS i, CAST(p_partkey % 40 AS INTEGER) AS j, CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size * 5 END AS INTEGER) AS val FROM part)"""


def image(spark, sf):
    k = F.col("p_partkey")
    return read_table(spark, sf, "part").select(F.expr("p_partkey DIV 40").cast("int").alias("i"), (k % 40).cast("int").alias("j"), F.when(F.col("p_size") % 7 == 0, 0).otherwise(F.col("p_size") * 5).cast("int").alias("val"))


@query("i1_colormap_ids", "SELECT * FROM (VALUES ('gray', 0), ('viridis', 1), ('magma', 2), ('fire', 3), ('red', 4), ('green', 5), ('blue', 6), ('cyan', 7), ('magenta', 8), ('other', 0)) t(name, id)")
def i1(spark, sf):
    return spark.createDataFrame([(n, I.colormap_id(n)) for n in (*I.COLORMAPS, "other")], "name string, id int")


@query("i2_colormap_lut", "SELECT CAST(i AS INTEGER) AS val, CASE WHEN i = 0 THEN 4278190080 ELSE 4278190080 + CAST(trunc(least(greatest((i - 40) / 120.0e0 * 255.0e0, 0), 255)) AS BIGINT) * 65793 END AS argb FROM range(256) t(i)")
def i2(spark, sf):
    values = spark.range(256).select(F.col("id").cast("int").alias("val"))
    return I.apply_lut(values, I.lut(40, 160, I.colormap_id("gray")))


@query("i3_apply_lut", f"WITH {IMAGE} SELECT i, j, val, CASE WHEN val = 0 THEN 4278190080 ELSE 4278190080 + CAST(val AS BIGINT) * 65536 END AS argb FROM img")
def i3(spark, sf):
    return I.apply_lut(image(spark, sf), I.lut(0, 255, I.colormap_id("red")))


def _dog_sql(r=2, gain=0.8):
    steps, last = ["p0 AS (SELECT i, j, val, CAST(val AS DOUBLE) AS a, CASE WHEN val > 0 THEN 1.0e0 ELSE 0.0e0 END AS w FROM img)"], "p0"
    for k in range(3):
        for part, order, tag in (("i", "j", "h"), ("j", "i", "v")):
            win = f"OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"
            steps.append(f"{tag}{k} AS (SELECT i, j, val, sum(a) {win} AS a, sum(w) {win} AS w FROM {last})")
            last = f"{tag}{k}"
        if k < 2:
            steps.append(f"n{k} AS (SELECT i, j, val, CASE WHEN w > 0 AND val > 0 THEN a / w ELSE 0.0e0 END AS a, CASE WHEN val > 0 THEN 1.0e0 ELSE 0.0e0 END AS w FROM {last})")
            last = f"n{k}"
    return f"""WITH {IMAGE}, {", ".join(steps)} SELECT i, j, CASE WHEN val = 0 THEN 0 ELSE CAST(trunc(least(greatest(val + {gain}e0 * (val - CASE WHEN w > 0 THEN a / w ELSE val END), 1.0e0), 255.0e0)) AS INTEGER) END AS val FROM {last}"""


@query("i4_local_contrast", _dog_sql())
def i4(spark, sf):
    return I.difference_of_gaussians(image(spark, sf), 40, surface_height(spark, sf), 2.0, 0.8)


TAPS_SQL = ", ".join(f"({di}, {dj})" for dj, di in I.tap_offsets(4.0))


@query("i5_ambient_occlusion", f"""WITH {IMAGE}, taps(di, dj) AS (VALUES {TAPS_SQL}), m AS (SELECT a.i, a.j, CAST(a.val - b.val AS DOUBLE) - 2.0e0 AS dd FROM img a, taps JOIN img b ON b.i = a.i + di AND b.j = a.j + dj WHERE a.val > 0 AND b.val > 0),
o AS (SELECT i, j, avg(CASE WHEN dd <= 0 THEN 0.0e0 ELSE least(dd / 8.0e0, 1.0e0) * CASE WHEN dd > 24 THEN 24.0e0 / dd ELSE 1.0e0 END END) AS occ FROM m GROUP BY i, j)
SELECT i, j, CASE WHEN occ IS NULL THEN val ELSE {u8("round(val * (1.0e0 - 0.7e0 * occ), 6)")} END AS val FROM img LEFT JOIN o USING (i, j)""")
def i5(spark, sf):
    return I.occlusion(image(spark, sf), image(spark, sf), 4.0, 0.7)


@query("i6_auto_window", f"""WITH {IMAGE}, h AS (SELECT val, count(*) AS n FROM img WHERE val > 0 GROUP BY val), r AS (SELECT val, sum(n) OVER (ORDER BY val) AS cum, sum(n) OVER () AS total FROM h),
w AS (SELECT min(val) FILTER (cum >= total * 2 // 100) AS lo, min(val) FILTER (cum >= total * 98 // 100) AS hi FROM r) SELECT lo, greatest(hi, lo + 1) AS hi FROM w""")
def i6(spark, sf):
    return I.auto_window(image(spark, sf))


def _panel_points(axis):
    i, j = "16 - (i // 24 - 12) * 1.0e0", "16 + (i % 24 - 12) * 1.0e0"
    return {"z": ("16.0e0", i, j), "y": (i, "16.0e0", j), "x": (i, j, "16.0e0")}[axis]


def _panels_sql():
    parts = []
    for k, a in enumerate("zyx"):
        z, y, x = _panel_points(a)
        parts.append(f"SELECT {k} AS panel, i // 24 AS i, i % 24 AS j, {z} AS z, {y} AS y, {x} AS x FROM range(576) t(i)")
    return f"""WITH vox AS ({vox_sql(32)}), p AS ({" UNION ALL ".join(parts)}), s AS (SELECT panel, i, j, coalesce(v, 0) AS val FROM p LEFT JOIN vox USING (z, y, x)
UNION ALL SELECT 3, i // 24, i % 24, coalesce((SELECT max(v) FROM vox WHERE vox.z BETWEEN 12 AND 20 AND vox.y = 16 - (i // 24 - 12) AND vox.x = 16 + (i % 24 - 12)), 0) FROM range(576) t(i))
SELECT CAST(panel AS INTEGER) AS panel, count(*) FILTER (val > 0) AS n_nonzero, CAST(sum(val) AS BIGINT) AS total, CAST(min(val) AS INTEGER) AS least, CAST(max(val) AS INTEGER) AS most FROM s GROUP BY panel"""


@query("i7_mosaic_stats", _panels_sql())
def i7(spark, sf):
    """Three slices through a focus voxel and a MAX panel around it."""
    volume = vox(spark, sf)
    grid = dense_grid(spark, 1, 24, 24).select(F.col("y").alias("i"), F.col("x").alias("j"))
    up, right = 16.0 - (F.col("i") - 12), 16.0 + (F.col("j") - 12)
    at = {"z": (F.lit(16.0), up, right), "y": (up, F.lit(16.0), right), "x": (up, right, F.lit(16.0))}
    normals = [F.lit(x).alias(c) for x, c in zip((1.0, 0.0, 0.0), M.NORMAL, strict=True)]
    panels = [N.render(volume, grid.select("i", "j", *(e.cast("double").alias(c) for e, c in zip(at[a], M.POINT, strict=True)), *normals), "none") for a in "zyx"]
    surface = grid.select("i", "j", *(e.cast("double").alias(c) for e, c in zip(at["z"], M.POINT, strict=True)), *normals)
    return I.panel_stats(I.mosaic([*panels, N.render(volume, surface, "max", -4, 4, 1.0)], 24, 24))



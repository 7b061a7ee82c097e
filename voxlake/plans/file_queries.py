"""Queries of files that are written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import scratch_path
from ..operators import image as I
from ..sources import surface_files as S
from ..sources.volumes import read_table, vox, vox_sql
from .image_queries import IMAGE, image
from .register import query
from .volume_queries import SURFACE, surface, surface_height


@query("a28_obj_grid", f"WITH {SURFACE} SELECT gy, gx, CAST(pz AS DOUBLE) AS pz, CAST(py AS DOUBLE) AS py, CAST(px AS DOUBLE) AS px FROM grid WHERE pz IS NOT NULL")
def a28(spark, sf):
    """The surface of all parts as an OBJ: its valid points come back in their cells."""
    path = scratch_path(spark, "grid") + ".obj"
    S.save_obj_grid(surface(spark, sf), 40, surface_height(spark, sf), path)
    return S.load_obj_grid(spark, path)


@query("a28_obj_faces", f"""WITH {SURFACE}, n AS (SELECT gy, gx, row_number() OVER (ORDER BY gy, gx) - 1 AS k FROM grid WHERE pz IS NOT NULL),
q AS (SELECT a.gy, a.gx, a.k AS a, b.k AS b, c.k AS c, d.k AS d FROM n a JOIN n b ON b.gy = a.gy AND b.gx = a.gx + 1 JOIN n c ON c.gy = a.gy + 1 AND c.gx = a.gx JOIN n d ON d.gy = a.gy + 1 AND d.gx = a.gx + 1),
t AS (SELECT gy, gx, 0 AS h, a, b, c FROM q UNION ALL SELECT gy, gx, 1, b, d, c FROM q)
SELECT CAST(row_number() OVER (ORDER BY gy, gx, h) - 1 AS INTEGER) AS tid, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(c AS INTEGER) AS c FROM t""")
def a28f(spark, sf):
    """The triangles of the same file, read as a mesh."""
    path = scratch_path(spark, "grid") + ".obj"
    S.save_obj_grid(surface(spark, sf), 40, surface_height(spark, sf), path)
    return S.load_obj_mesh(spark, path)[1]


@query("a29_obj_mesh", "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS vid, o_orderkey % 1009 / 8.0e0 AS x, o_custkey % 977 / 3.0e0 AS y, o_orderkey % 31 + 0.0e0 AS z FROM orders")
def a29(spark, sf):
    """A vertex an order, and triangles of neighbours; the vertices come back."""
    from ..functions.order import ranked

    path = scratch_path(spark, "mesh") + ".obj"
    k = F.col("o_orderkey")
    v = ranked(read_table(spark, sf, "orders"), [k], "n").select((F.col("n") - 1).cast("int").alias("vid"), (k % 1009 / 8.0).alias("x"), (F.col("o_custkey") % 977 / 3.0).alias("y"), (k % 31).cast("double").alias("z"))
    t = v.where("vid >= 2").select((F.col("vid") - 2).alias("tid"), (F.col("vid") - 2).alias("a"), (F.col("vid") - 1).alias("b"), F.col("vid").alias("c"))
    S.save_obj_mesh(v, t, path)
    return S.load_obj_mesh(spark, path)[0]


@query("a31_pixel_map", f"""WITH {SURFACE}, g AS (SELECT CAST(i // 40 AS INTEGER) AS gy, CAST(i % 40 AS INTEGER) AS gx FROM dim, range(h * 40) t(i)),
p AS (SELECT gy, gx, pz, py, px, pz IS NOT NULL AND NOT (pz = 0 AND py = 0 AND px = 0) AS ok FROM g LEFT JOIN grid USING (gy, gx))
SELECT gy, gx, CAST(CASE WHEN ok THEN pz END AS DOUBLE) AS pz, CAST(CASE WHEN ok THEN py END AS DOUBLE) AS py, CAST(CASE WHEN ok THEN px END AS DOUBLE) AS px, CASE WHEN ok THEN 3.0e0 ELSE 0.0e0 END AS depth FROM p""")
def a31(spark, sf):
    """The surface of all parts as a map of doubles, written and read by ranges of records."""
    path = scratch_path(spark, "map") + ".vc"
    S.save_pixel_map(surface(spark, sf), 40, surface_height(spark, sf), path)
    return S.load_pixel_map(spark, path, 3.0)


@query("a32_ppm", f"""WITH {IMAGE}, dim AS (SELECT coalesce(max(i), 0) + 1 AS h FROM img), g AS (SELECT k // 40 AS i, k % 40 AS j FROM dim, range(h * 40) t(k))
SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(coalesce(val, 0) AS INTEGER) AS r, CAST(0 AS INTEGER) AS g, CAST(0 AS INTEGER) AS b FROM g LEFT JOIN img USING (i, j)""")
def a32(spark, sf):
    """The image of all parts in red, as a PPM."""
    path = scratch_path(spark, "image") + ".ppm"
    S.save_ppm(I.apply_lut(image(spark, sf), I.lut(0, 255, I.colormap_id("red"))), 40, surface_height(spark, sf), path)
    return S.load_ppm(spark, path)


@query("a33_raw_export", f"WITH vox AS ({vox_sql(64)}) SELECT CAST(z - 3 AS INTEGER) AS z, CAST(y + 4 AS INTEGER) AS y, CAST(x - 10 AS INTEGER) AS x, v FROM vox WHERE v > 0 AND z BETWEEN 3 AND 52 AND y < 36 AND x BETWEEN 10 AND 69")
def a33_raw(spark, sf):
    """A dense box, reaching beyond the volume, as raw bytes."""
    path = scratch_path(spark, "box") + ".raw"
    S.save_raw(vox(spark, sf, 64), (3, -4, 10, 50, 40, 60), path)
    return S.load_raw(spark, path, (50, 40, 60))

"""Queries over zarr levels that are written from order lines, planned over the listing of their objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import scratch_path
from ..operators import aggregate as A
from ..sources import zarr2
from ..sources.volumes import vox, vox_sql
from .register import query

DIM, EDGE, BLOCK = 64, 16, 1024
#: A volume that fills only a part of its grid, so that most chunks have no object.
PART = "z < 40 AND (y >= 32 OR x < 16)"
VOX64 = f"WITH vox AS (SELECT * FROM ({vox_sql(DIM)}) WHERE v > 0 AND {PART})"
BOX = (5, 30, 7, 20, 20, 30)
IN_BOX = "z BETWEEN 5 AND 24 AND y BETWEEN 30 AND 49 AND x BETWEEN 7 AND 36"


def _level(spark, sf, codec="raw", separator="."):
    root = scratch_path(spark, "zarr")
    zarr2.write_level(vox(spark, sf, DIM).where(PART), root, 0, (DIM,) * 3, EDGE, codec, separator, BLOCK)
    return root


@query("a4_zarr_scan", f"{VOX64} SELECT CAST(0 AS INTEGER) AS lod, z, y, x, v FROM vox")
def a4(spark, sf):
    """A level of compressed chunks, written and scanned whole."""
    return zarr2.voxels(zarr2.read_level(spark, _level(spark, sf, "blosc", "/")), EDGE)


@query("a3_zarr_states", f"""{VOX64}, c AS (SELECT DISTINCT z // {EDGE} AS cz, y // {EDGE} AS cy, x // {EDGE} AS cx FROM vox)
SELECT CAST(i // 16 AS INTEGER) AS cz, CAST(i // 4 % 4 AS INTEGER) AS cy, CAST(i % 4 AS INTEGER) AS cx, CAST(CASE WHEN c.cz IS NULL THEN 2 ELSE 1 END AS INTEGER) AS state
FROM range(64) t(i) LEFT JOIN c ON c.cz = i // 16 AND c.cy = i // 4 % 4 AND c.cx = i % 4""")
def a3(spark, sf):
    """Every chunk of the grid: those without an object are air."""
    return zarr2.read_level(spark, _level(spark, sf)).select("cz", "cy", "cx", "state")


@query("a6_zarr_objects", f"{VOX64} SELECT DISTINCT CAST(z // {EDGE} AS INTEGER) AS cz, CAST(y // {EDGE} AS INTEGER) AS cy, CAST(x // {EDGE} AS INTEGER) AS cx, CAST({EDGE**3} AS BIGINT) AS length FROM vox WHERE y // {EDGE} >= 2")
def a6(spark, sf):
    """Which chunks are stored and how large they are, without fetching one; a condition on coordinates is put to the listing."""
    return zarr2.stored(spark, _level(spark, sf, separator="/")).where("cy >= 2").select("cz", "cy", "cx", "length")


@query("a9_zarr_box", f"{VOX64} SELECT z, y, x, v FROM vox WHERE {IN_BOX}")
def a9(spark, sf):
    """A box out of compressed chunks: of each only the frames' blocks that hold its planes are fetched."""
    return zarr2.region(spark, _level(spark, sf, "blosc"), *BOX)[0]


@query("a13_zarr_range_bytes", f"""{VOX64}, c AS (SELECT DISTINCT z // {EDGE} AS cz, y // {EDGE} AS cy, x // {EDGE} AS cx FROM vox WHERE z // {EDGE} BETWEEN 0 AND 1 AND y // {EDGE} BETWEEN 1 AND 3 AND x // {EDGE} BETWEEN 0 AND 2)
SELECT '0/' || cz || '.' || cy || '.' || cx AS key, CAST({EDGE**3} AS BIGINT) AS length, CAST((least(25 - cz * {EDGE}, {EDGE}) - greatest(5 - cz * {EDGE}, 0)) * {EDGE**2} AS BIGINT) AS fetched FROM c""")
def a13(spark, sf):
    """Bytes fetched for a box out of raw chunks: its planes of each, and no chunk that it doesn't touch."""
    return zarr2.region(spark, _level(spark, sf), *BOX)[1]


@query("a15_zarr_pyramid", f"""{VOX64}, l1 AS (SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, (CAST(sum(v) AS BIGINT) + count(*) // 2) // count(*) AS v FROM vox GROUP BY 1, 2, 3)
SELECT CAST(0 AS INTEGER) AS lod, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM vox UNION ALL SELECT 1, count(*), CAST(sum(v) AS BIGINT) FROM l1""")
def a15(spark, sf):
    """Levels up to the first gap, read together."""
    root = _level(spark, sf)
    half = A.decimate(vox(spark, sf, DIM).where(PART))
    for lod in (1, 3):
        zarr2.write_level(half, root, lod, (DIM // 2,) * 3, EDGE)
    return zarr2.voxels(zarr2.read_pyramid(spark, root), EDGE).groupBy("lod").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))

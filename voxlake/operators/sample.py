"""Point sampling: a lookup of neighbour voxels is an equi-join on three integers.

Missing voxels are air (0), so joins are outer; points with a coordinate below 0 or NaN give 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import AXES, cell_of, to_lod, to_u8


def valid_point(cols=("pz", "py", "px")) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.coalesce((F.col(c) >= 0) & ~F.isnan(c), F.lit(False))
    return ok


def _nearest(points: DataFrame, voxels: DataFrame, extra: list[str]) -> DataFrame:
    ok = valid_point()
    keyed = points.select("*", *(F.when(ok, F.floor(F.col(f"p{a}") + 0.5).cast("int")).alias(a) for a in AXES))
    found = voxels.where("v > 0").select(*extra, *AXES, F.col("v").cast("double").alias("f"))
    return keyed.join(found, [*extra, *AXES], "left").drop(*AXES).withColumn("f", F.coalesce("f", F.lit(0.0)))


CORNERS = [dict(zip(AXES, (k >> 2 & 1, k >> 1 & 1, k & 1), strict=True)) for k in range(8)]


def voxel_cells(voxels: DataFrame, extra: list[str]) -> DataFrame:
    """(extra, _z, _y, _x, v0..v7): a row a cell between voxels of material, with the values at its corners; null for air."""
    sent = F.array(*(F.struct(*((F.col(a) - d[a]).alias(f"_{a}") for a in AXES), F.lit(k).alias("_corner")) for k, d in enumerate(CORNERS)))
    rows = voxels.where("v > 0").select(*extra, "v", F.explode(sent).alias("c")).select(*extra, "v", "c.*").where("least(_z, _y, _x) >= 0")
    return rows.groupBy(*extra, "_z", "_y", "_x").agg(*(F.max(F.when(F.col("_corner") == k, F.col("v"))).alias(f"v{k}") for k in range(8)))


def _trilinear(points: DataFrame, voxels: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """A point meets its cell once; what a task holds follows its points, not eight rows for each and their groups."""
    ok = valid_point()
    # Points that give 0 are spread over keys that no cell has.
    nowhere = -1 - F.pmod(F.xxhash64(*keys), F.lit(1 << 20)).cast("int")
    placed = points.select(*keys, *extra, *(F.when(ok, F.col(f"p{a}") - F.floor(f"p{a}")).alias(f"_f{a}") for a in AXES), *(F.when(ok, F.floor(f"p{a}").cast("int")).otherwise(nowhere).alias(f"_{a}") for a in AXES))
    met = placed.join(voxel_cells(voxels, extra), [*extra, "_z", "_y", "_x"], "left")
    total = None
    for k, d in enumerate(CORNERS):
        w = F.lit(1.0)
        for a in AXES:
            w = w * (F.col(f"_f{a}") if d[a] else 1.0 - F.col(f"_f{a}"))
        term = F.when(F.col(f"v{k}").isNotNull(), w * F.col(f"v{k}")).otherwise(F.lit(0.0))
        total = term if total is None else total + term
    return met.select(*keys, *extra, total.alias("f"))


def sample(points: DataFrame, voxels: DataFrame, keys: list[str], trilinear: bool = True, extra: list[str] | None = None) -> DataFrame:
    """(keys, f): the value at every point (pz, py, px). ``extra`` are further join columns, such as lod.

    A point costs one lookup: of its voxel, or of its cell with the values at all corners.
    """
    extra = extra or []
    if trilinear:
        return _trilinear(points, voxels, keys, extra)
    return _nearest(points.select(*keys, *extra, "pz", "py", "px"), voxels, extra).select(*keys, *extra, "f")


def as_u8(sampled: DataFrame) -> DataFrame:
    return sampled.withColumn("f", to_u8(F.col("f")))


def lod_fallback(points: DataFrame, levels: DataFrame, resident: DataFrame, keys: list[str], n_lods: int, edge: int, lod: int = 0, trilinear: bool = False) -> DataFrame:
    """(keys, lod, f): the nearest voxel, or the trilinear value, at the finest level from ``lod`` whose block is resident; no level, 0.

    ``levels`` is (lod, z, y, x, v), ``resident`` (lod, bz, by, bx).
    """
    each = points.select(*keys, "pz", "py", "px", F.explode(F.array(*map(F.lit, range(lod, n_lods)))).alias("lod"))
    scaled = each
    for a in AXES:
        at = F.col(f"p{a}")
        for level in range(1, n_lods):
            at = F.when(F.col("lod") == level, to_lod(F.col(f"p{a}"), level)).otherwise(at)
        scaled = scaled.withColumn(f"q{a}", at)
    keyed = scaled.select(*keys, "lod", *(F.col(f"q{a}").alias(f"p{a}") for a in AXES), *(cell_of(F.greatest(F.floor(f"q{a}"), F.lit(0)).cast("int"), edge).alias(f"b{a}") for a in AXES))
    have = keyed.join(resident, ["lod", "bz", "by", "bx"], "left_semi")
    best = have.groupBy(*keys).agg(F.min(F.struct("lod", "pz", "py", "px")).alias("b")).select(*keys, "b.*")
    best = best.withColumns({f"p{a}": F.greatest(f"p{a}", F.lit(0.0)) for a in AXES})
    found = sample(best, levels, keys, trilinear, ["lod"])
    return points.select(*keys).join(found, keys, "left").withColumn("f", F.coalesce("f", F.lit(0.0)))


def best_lod(blocks: DataFrame, resident: DataFrame, keys: list[str], n_lods: int) -> DataFrame:
    """(keys, lod): the finest resident level that covers a level-0 block, -1 for none."""
    each = blocks.select(*keys, "bz", "by", "bx", F.explode(F.array(*map(F.lit, range(n_lods)))).alias("lod"))
    up = each.select(*keys, "lod", *(F.expr(f"shiftright(b{a}, lod)").alias(f"b{a}") for a in AXES))
    hit = up.join(resident, ["lod", "bz", "by", "bx"], "left_semi").groupBy(*keys).agg(F.min("lod").alias("lod"))
    return blocks.select(*keys).join(hit, keys, "left").withColumn("lod", F.coalesce("lod", F.lit(-1)))


def pick_lod(voxels_per_pixel: float, n_lods: int, empty: frozenset[int] = frozenset()) -> int:
    """The level at which a pixel covers less than two voxels, stepped back over empty levels."""
    lod = 0
    while voxels_per_pixel >= 2.0 and lod < n_lods - 1:
        voxels_per_pixel, lod = voxels_per_pixel / 2, lod + 1
    while lod > 0 and lod in empty:
        lod -= 1
    return lod


def box_points(spark, origin, du, dv, dw, w: int, h: int, d: int) -> DataFrame:
    """(k, i, j, pz, py, px) of an oriented box: origin + j du + i dv + k dw."""
    rows = spark.range(w * h * d).select(F.expr(f"id DIV {w * h}").cast("int").alias("k"), F.expr(f"(id DIV {w}) % {h}").cast("int").alias("i"), (F.col("id") % w).cast("int").alias("j"))
    return rows.select("k", "i", "j", *((F.lit(float(origin[n])) + F.col("j") * float(du[n]) + F.col("i") * float(dv[n]) + F.col("k") * float(dw[n])).alias(f"p{a}") for n, a in enumerate(AXES)))


def unit(v) -> tuple[float, float, float]:
    n = math.sqrt(sum(x * x for x in v))
    return tuple(float(x) / n for x in v) if n > 1e-12 else tuple(map(float, v))

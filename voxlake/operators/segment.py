"""Neighbourhood operators and segmentation over voxel tables.

Masks are tables of their foreground voxels (z, y, x); dense fields have a row for every voxel.
Filters are separable: one window per axis over dense lines, three shuffles in all. Components
and distances work on packed tiles, in modules of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import AXES, dense_grid
from ..functions.scratch import materialize
from .components import component_sizes, fill_cavities, label, remove_small  # noqa: F401
from .distances import distance, signed_distance, squared_distance  # noqa: F401


def densify(voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """(z, y, x, v) with a row for every voxel of the box."""
    return dense_grid(voxels.sparkSession, *dims).join(voxels.select(*AXES, "v"), list(AXES), "left").select(*AXES, F.coalesce("v", F.lit(0)).alias("v"))


def line_window(axis: str):
    others = [a for a in AXES if a != axis]
    return Window.partitionBy(*others).orderBy(axis)


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights of offsets 0..r of the normalised kernel of radius ceil(3 sigma)."""
    r = max(1, math.ceil(3 * sigma))
    half = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(r + 1)]
    total = half[0] + 2 * sum(half[1:])
    return [h / total for h in half]


def gaussian_blur(field: DataFrame, sigma: float, columns: list[str]) -> DataFrame:
    """Separable blur of dense columns; beyond the ends of a line its end values repeat."""
    weights = gaussian_kernel(sigma)
    for axis in AXES:
        w = line_window(axis)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        out = {}
        for c in columns:
            start, end = F.first(c).over(whole), F.last(c).over(whole)
            total = F.col(c) * weights[0]
            for k, h in enumerate(weights[1:], 1):
                total = total + h * (F.coalesce(F.lag(c, k).over(w), start) + F.coalesce(F.lead(c, k).over(w), end))
            out[c] = total
        others = [n for n in field.columns if n not in columns]
        field = field.select(*others, *(e.alias(c) for c, e in out.items()))
    return field


def box_blur(field: DataFrame, radius: int, column: str) -> DataFrame:
    """Mean over a cube, axis by axis x, y, z, over what lies inside the volume."""
    for axis in reversed(AXES):
        field = field.withColumn(column, F.avg(column).over(line_window(axis).rowsBetween(-radius, radius)))
    return field


def gradients(field: DataFrame, column: str) -> DataFrame:
    """Adds gz, gy, gx: half the difference of the neighbours, the voxel itself where one is missing."""
    for axis in AXES:
        w = line_window(axis)
        field = field.withColumn(f"g{axis}", 0.5 * (F.coalesce(F.lead(column).over(w), F.col(column)) - F.coalesce(F.lag(column).over(w), F.col(column))))
    return field


def _blur_axis(a: np.ndarray, weights: list[float], axis: int) -> np.ndarray:
    r, n = len(weights) - 1, a.shape[axis]
    pad = [(r, r) if k == axis else (0, 0) for k in range(a.ndim)]
    wide = np.pad(a, pad, mode="edge")
    out = weights[0] * a
    for k, h in enumerate(weights[1:], 1):
        out = out + h * (np.take(wide, range(r - k, r - k + n), axis) + np.take(wide, range(r + k, r + k + n), axis))
    return out


def sheetness(dense: np.ndarray, sigma_gradient: float, sigma_tensor: float) -> np.ndarray:
    """(l0 - l1) / (l0 + 1e-6) of the smoothed structure tensor of a box; its outer faces repeat their values."""
    f = dense.astype(np.float64)
    for axis in range(3):
        f = _blur_axis(f, gaussian_kernel(sigma_gradient), axis)
    g = []
    for axis in range(3):
        wide = np.pad(f, [(1, 1) if k == axis else (0, 0) for k in range(3)], mode="edge")
        n = f.shape[axis]
        g.append(0.5 * (np.take(wide, range(2, n + 2), axis) - np.take(wide, range(n), axis)))
    tensor = np.empty((*f.shape, 3, 3))
    for i in range(3):
        for j in range(i, 3):
            t = g[i] * g[j]
            for axis in range(3):
                t = _blur_axis(t, gaussian_kernel(sigma_tensor), axis)
            tensor[..., i, j] = tensor[..., j, i] = t
    values = np.linalg.eigvalsh(tensor)
    l0, l1 = values[..., 2], values[..., 1]
    return np.where(l0 > 1e-6, (l0 - l1) / (l0 + 1e-6), 0.0)


def detect_sheets(dense: DataFrame, dims: tuple[int, int, int], sigma_gradient: float = 1.0, sigma_tensor: float = 2.0, threshold: float = 0.5, value_low: int = 1, tile: int = 64) -> DataFrame:
    """Foreground (z, y, x) of voxels (z, y, x, v): where one direction of change dominates.

    A tile is sent its voxels and a halo as wide as the filters reach, so there is one shuffle and a
    task holds one tile; at the volume's faces values repeat.
    """
    halo = len(gaussian_kernel(sigma_gradient)) + len(gaussian_kernel(sigma_tensor)) - 1
    sent = dense.where("v > 0")
    for a, n in zip(AXES, dims, strict=True):
        sent = sent.withColumn(f"t{a}", F.explode(F.sequence(F.expr(f"CAST(greatest({a} - {halo}, 0) DIV {tile} AS INT)"), F.expr(f"CAST(least({a} + {halo}, {n - 1}) DIV {tile} AS INT)"))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo = [max(k * tile - halo, 0) for k in key]
        hi = [min((k + 1) * tile + halo, n) for k, n in zip(key, dims, strict=True)]
        box = np.zeros([b - a for a, b in zip(lo, hi, strict=True)])
        box[tuple(pdf[c] - a for c, a in zip(AXES, lo, strict=True))] = pdf["v"]
        found = (sheetness(box, sigma_gradient, sigma_tensor) >= threshold) & (box >= max(value_low, 1))
        at = np.argwhere(found) + lo
        own = np.all([(at[:, k] // tile) == key[k] for k in range(3)], 0)
        return pd.DataFrame(at[own].astype(np.int32), columns=list(AXES))

    return sent.groupBy("tz", "ty", "tx").applyInPandas(run, "z int, y int, x int")


# ---------------------------------------------------------------- morphology

CUBE = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]


def _moved(mask: DataFrame, offsets, sign: int = 1) -> DataFrame:
    o = F.explode(F.array(*(F.struct(*(F.lit(sign * v).alias(a) for a, v in zip(AXES, off, strict=True))) for off in offsets)))
    return mask.select(*AXES, o.alias("_o")).select(*((F.col(a) + F.col(f"_o.{a}")).alias(a) for a in AXES))


def _inside(dims) -> Column:
    ok = F.lit(True)
    for a, n in zip(AXES, dims, strict=True):
        ok = ok & F.col(a).between(0, n - 1)
    return ok


def plug_holes(mask: DataFrame, dims: tuple[int, int, int], passes: int = 1) -> DataFrame:
    """Fills every 2x2x2 cube of which 5 to 7 voxels are set; a pass sees the mask before it."""
    for _ in range(max(passes, 1)):
        counts = _moved(mask, CUBE, -1).where(_inside([n - 1 for n in dims])).groupBy(*AXES).agg(F.count(F.lit(1)).alias("c"))
        mask = mask.select(*AXES).unionByName(_moved(counts.where("c BETWEEN 5 AND 7"), CUBE)).distinct()
    return mask


def plug_holes_raster(mask: np.ndarray, passes: int = 1) -> tuple[np.ndarray, int]:
    """The in-place variant for one chunk: cubes in raster order see what earlier cubes filled."""
    out, added = mask.astype(bool).copy(), 0
    nz, ny, nx = out.shape
    for _ in range(max(passes, 1)):
        before = added
        for z in range(nz - 1):
            for y in range(ny - 1):
                for x in range(nx - 1):
                    cube = out[z : z + 2, y : y + 2, x : x + 2]
                    n = int(cube.sum())
                    if 5 <= n < 8:
                        cube[...] = True
                        added += 8 - n
        if added == before:
            break
    return out, added


def ball(radius: int) -> list[tuple[int, int, int]]:
    r = range(-radius, radius + 1)
    return [(a, b, c) for a in r for b in r for c in r if a * a + b * b + c * c <= radius * radius]


def dilate(mask: DataFrame, radius: int, dims: tuple[int, int, int]) -> DataFrame:
    return _moved(mask, ball(radius)).where(_inside(dims)).distinct()


def erode(mask: DataFrame, radius: int) -> DataFrame:
    """Voxels whose whole ball is set; outside the volume counts as background."""
    offsets = ball(radius)
    hits = _moved(mask, offsets, -1).groupBy(*AXES).agg(F.count(F.lit(1)).alias("c"))
    return hits.where(F.col("c") == len(offsets)).select(*AXES)


def close(mask: DataFrame, radius: int, dims: tuple[int, int, int]) -> DataFrame:
    return erode(dilate(mask, radius, dims), radius)


# ---------------------------------------------------------------- the whole


def detect_pipeline(dense: DataFrame, dims: tuple[int, int, int], least: int = 20, **params) -> DataFrame:
    """Sheets, cleaned: small components go, holes are plugged, gaps closed, cavities filled, the rest labelled."""
    mask = materialize(detect_sheets(dense, dims, **params), "sheets")
    mask = remove_small(mask, dims[1], dims[2], least)
    mask = close(plug_holes(mask, dims, 2), 1, dims)
    return label(fill_cavities(materialize(mask, "closed"), dims), dims[1], dims[2])

"""Compositing along rays: ordered aggregates of samples (i, j, step, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import AXES, to_u8
from .sample import sample


def steps_of(t0: float, t1: float, dt: float) -> tuple[float, float, int]:
    """(first t, dt, number of steps) of a walk over [t0, t1]; the ends may be swapped, dt <= 0 counts as 1."""
    lo, hi, dt = min(t0, t1), max(t0, t1), dt if dt > 0 else 1.0
    n, t = 0, lo
    while t <= hi + 1e-4:
        n, t = n + 1, t + dt
    return lo, dt, n


def ray_points(pixels: DataFrame, t0: float, t1: float, dt: float = 1.0) -> DataFrame:
    """(i, j, step, point): points P + t N of every pixel with a point; N is made a unit, a pixel without one gets P alone."""
    lo, dt, n = steps_of(t0, t1, dt)
    size = F.sqrt(F.col("nz") * F.col("nz") + F.col("ny") * F.col("ny") + F.col("nx") * F.col("nx"))
    flat = F.coalesce(size < 1e-6, F.lit(True))
    steps = F.when(flat, F.array(F.lit(-1))).otherwise(F.array(*map(F.lit, range(n))))
    rows = pixels.where("pz IS NOT NULL").withColumns({"_len": size, "step": F.explode(steps)})
    t = F.lit(lo) + F.col("step") * dt
    return rows.select("i", "j", "step", *(F.when(F.col("step") < 0, F.col(f"p{a}")).otherwise(F.col(f"p{a}") + t * F.col(f"n{a}") / F.col("_len")).alias(f"p{a}") for a in AXES))


def ray_samples(voxels: DataFrame, pixels: DataFrame, t0: float, t1: float, dt: float = 1.0, trilinear: bool = True) -> DataFrame:
    """(i, j, step, v) along all rays. The number of steps is a parameter, so a ray is a bounded group."""
    return sample(ray_points(pixels, t0, t1, dt), voxels, ["i", "j", "step"], trilinear).withColumnRenamed("f", "v")


def alpha_fold(alpha_min: float = 0.0, opacity: float = 1.0, stop: float = 0.98) -> Column:
    """Front-to-back accumulation over the steps; it ends once the accumulated opacity reaches ``stop``."""
    low = min(max(alpha_min, 0.0), 0.99)
    gain = (opacity if 0 < opacity <= 1 else 1.0) / (1.0 - low)
    ordered = F.array_sort(F.collect_list(F.struct("step", "v")))

    def step(s, x):
        a = F.least(F.greatest((x["v"] / 255.0 - low) * gain, F.lit(0.0)), F.lit(1.0))
        live = s["op"] < stop
        rest = (1.0 - s["op"]) * a
        return F.struct(F.when(live, s["acc"] + rest * x["v"]).otherwise(s["acc"]).alias("acc"), F.when(live, s["op"] + rest).otherwise(s["op"]).alias("op"))

    zero = F.struct(F.lit(0.0).alias("acc"), F.lit(0.0).alias("op"))
    return F.aggregate(ordered, zero, step)["acc"]


def composite(samples: DataFrame, mode: str, n_steps: int, alpha_min: float = 0.0, opacity: float = 1.0, percentile: float = 0.9) -> DataFrame:
    """(i, j, val 0..255) for mode none, min, max, mean, stddev, alpha, percentile or depth."""
    v = F.col("v")
    if mode == "min":
        value = F.min(v)
    elif mode == "max":
        value = F.max(v)
    elif mode in ("mean", "none"):
        value = F.sum(v) / F.count(v)
    elif mode == "stddev":
        n = F.count(v)
        mean = F.sum(v) / n
        value = F.sqrt(F.greatest(F.sum(v * v) / n - mean * mean, F.lit(0.0)))
    elif mode == "alpha":
        value = alpha_fold(alpha_min, opacity)
    elif mode == "percentile":
        stride = max(1, -(-n_steps // 1024))
        kept = F.sort_array(F.collect_list(F.when(F.col("step") % stride == 0, v)))
        p = percentile if 0 < percentile <= 1 else 0.9
        value = F.element_at(kept, (F.floor(p * (F.size(kept) - 1) + 0.5) + 1).cast("int"))
    elif mode == "depth":
        low = min(max(alpha_min, 0.0), 0.99)
        hit = F.min(F.when(v / 255.0 > low, F.col("step")))
        frac = hit / float(n_steps - 1) if n_steps > 1 else F.lit(0.0)
        return samples.groupBy("i", "j").agg(F.when(hit.isNull(), F.lit(0)).otherwise(F.floor(1.0 + 254.0 * frac + 0.5)).cast("int").alias("val"))
    else:
        raise ValueError(f"unknown mode {mode}")
    return samples.groupBy("i", "j").agg(to_u8(value).alias("val"))


def render(voxels: DataFrame, pixels: DataFrame, mode: str, t0: float = 0.0, t1: float = 0.0, dt: float = 1.0, trilinear: bool = True, **params) -> DataFrame:
    """An image (i, j, val) over all pixels; pixels without a point are 0."""
    if mode == "none":
        t0 = t1 = 0.0
    n = steps_of(t0, t1, dt)[2]
    image = composite(ray_samples(voxels, pixels, t0, t1, dt, trilinear), mode, n, **params)
    return pixels.select("i", "j").join(image, ["i", "j"], "left").withColumn("val", F.coalesce("val", F.lit(0)))


def lod_matched(pixels: DataFrame, lod: int, t0: float, t1: float) -> tuple[DataFrame, float, float]:
    """Pixels and ray range in the coordinates of a level; coordinates that fall below 0 are clamped to it."""
    scale = 2.0**-lod
    moved = {f"p{a}": F.greatest((F.col(f"p{a}") + 0.5) * scale - 0.5, F.lit(0.0)) for a in AXES}
    return (pixels.withColumns(moved) if lod else pixels), t0 * scale, t1 * scale

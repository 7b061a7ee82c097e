"""Image operators over (i, j, val): lookup tables, local contrast, occlusion, windows, mosaics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import to_u8

#: Colormap names by id.
COLORMAPS = ("gray", "viridis", "magma", "fire", "red", "green", "blue", "cyan", "magenta")

#: Anchor colours (r, g, b) at equal steps; between them a map is interpolated.
ANCHORS = {
    "gray": ((0, 0, 0), (255, 255, 255)),
    "viridis": ((68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37)),
    "magma": ((0, 0, 4), (81, 18, 124), (183, 55, 121), (252, 137, 97), (252, 253, 191)),
    "fire": ((0, 0, 0), (128, 0, 0), (255, 64, 0), (255, 192, 0), (255, 255, 255)),
    "red": ((0, 0, 0), (255, 0, 0)),
    "green": ((0, 0, 0), (0, 255, 0)),
    "blue": ((0, 0, 0), (0, 0, 255)),
    "cyan": ((0, 0, 0), (0, 255, 255)),
    "magenta": ((0, 0, 0), (255, 0, 255)),
}

#: The twelve taps (x, y) of the occlusion disk.
TAPS = (
    (1.0, 0.0), (0.5, 0.866), (-0.5, 0.866), (-1.0, 0.0), (-0.5, -0.866), (0.5, -0.866),
    (0.433, 0.25), (0.0, 0.5), (-0.433, 0.25), (-0.433, -0.25), (0.0, -0.5), (0.433, -0.25),
)


def colormap_id(name: str | None) -> int:
    return COLORMAPS.index(name) if name in COLORMAPS else 0


def palette(cmap: int, value: int) -> tuple[int, int, int]:
    anchors = ANCHORS[COLORMAPS[cmap if 0 <= cmap < len(COLORMAPS) else 0]]
    at = value / 255 * (len(anchors) - 1)
    k = min(int(at), len(anchors) - 2)
    return tuple(int(a + (b - a) * (at - k) + 0.5) for a, b in zip(anchors[k], anchors[k + 1], strict=True))


def lut(low: float, high: float, cmap: int) -> list[int]:
    """256 ARGB values: a ramp from ``low`` to ``high`` through the colormap; value 0 is no material and black."""
    lo = int(min(max(low, 0), 255))
    hi = int(min(max(high, lo + 1), 255)) if high >= lo + 1 else lo + 1
    span = float(max(hi - lo, 1))
    out = []
    for i in range(256):
        r, g, b = palette(cmap, int(min(max((i - lo) / span * 255.0, 0), 255)))
        out.append(0xFF000000 | r << 16 | g << 8 | b)
    out[0] = 0xFF000000
    return out


def apply_lut(image: DataFrame, table: list[int]) -> DataFrame:
    """Adds ``argb``; the table has 256 entries and travels in the expression."""
    return image.withColumn("argb", F.element_at(F.array(*map(F.lit, table)).cast("array<bigint>"), F.col("val") + 1))


def _box(rows: DataFrame, r: int, part: str, order: str) -> DataFrame:
    w = Window.partitionBy(part).orderBy(order).rowsBetween(-r, r)
    return rows.withColumns({"a": F.sum("a").over(w), "w": F.sum("w").over(w)})


def difference_of_gaussians(image: DataFrame, width: int, height: int, sigma: float, gain: float) -> DataFrame:
    """Local contrast on a dense image: val + gain * (val - blur), clamped to 1..255; zeros are holes, excluded and kept.

    The blur is three passes of a box of radius int(sigma + 0.5), rows then columns; a pass weighs by
    the number of material pixels in its window.
    """
    if sigma < 1 or gain == 0:
        return image
    r = min(max(int(sigma + 0.5), 1), min(width, height) // 2)
    live = F.when(F.col("val") > 0, 1.0).otherwise(0.0)
    rows = image.withColumns({"a": F.col("val") * live, "w": live})
    for k in range(3):
        rows = _box(_box(rows, r, "i", "j"), r, "j", "i")
        if k < 2:
            rows = rows.withColumns({"a": F.when(F.col("w") > 0, F.col("a") / F.col("w") * live).otherwise(0.0), "w": live})
    blur = F.when(F.col("w") > 0, F.col("a") / F.col("w")).otherwise(F.col("val").cast("double"))
    sharp = F.col("val") + gain * (F.col("val") - blur)
    return rows.select("i", "j", F.when(F.col("val") == 0, 0).otherwise(F.least(F.greatest(sharp, F.lit(1.0)), F.lit(255.0)).cast("int")).alias("val"))


def tap_offsets(radius: float) -> list[tuple[int, int]]:
    """(dj, di) of the taps, rounded away from zero."""
    r = radius if radius > 0 else 8.0
    return [tuple(math.trunc(c * r + (-0.5 if c < 0 else 0.5)) for c in tap) for tap in TAPS]


def occlusion(depth: DataFrame, image: DataFrame, radius: float, strength: float) -> DataFrame:
    """Darkens pixels that nearer neighbours of the depth image (i, j, val) surround; halves round up, whatever the order of a sum."""
    s = 0.7 if strength <= 0 else min(strength, 1.0)
    taps = F.array(*(F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for dj, di in tap_offsets(radius)))
    live = depth.where("val > 0")
    asked = live.select("i", "j", F.col("val").alias("dc"), F.explode(taps).alias("o")).select("i", "j", "dc", (F.col("i") + F.col("o.di")).alias("ti"), (F.col("j") + F.col("o.dj")).alias("tj"))
    met = asked.join(live.select(F.col("i").alias("ti"), F.col("j").alias("tj"), F.col("val").alias("dn")), ["ti", "tj"])
    dd = F.col("dc") - F.col("dn") - 2.0
    o = F.least(dd / 8.0, F.lit(1.0)) * F.when(dd > 24.0, 24.0 / dd).otherwise(1.0)
    occ = met.groupBy("i", "j").agg(F.avg(F.when(dd <= 0, 0.0).otherwise(o)).alias("occ"))
    return image.join(occ, ["i", "j"], "left").select("i", "j", F.when(F.col("occ").isNull(), F.col("val")).otherwise(to_u8(F.round(F.col("val") * (1.0 - s * F.col("occ")), 6))).alias("val"))


def auto_window(image: DataFrame) -> DataFrame:
    """(lo, hi): values at which the histogram of nonzero pixels has passed 2 and 98 in a hundred; hi > lo."""
    counts = image.where("val > 0").groupBy("val").agg(F.count(F.lit(1)).alias("n"))
    run = counts.withColumns({"cum": F.sum("n").over(Window.orderBy("val")), "total": F.sum("n").over(Window.partitionBy())})
    lo = F.coalesce(F.min(F.when(F.col("cum") >= F.expr("total * 2 DIV 100"), F.col("val"))), F.lit(0))
    hi = F.coalesce(F.min(F.when(F.col("cum") >= F.expr("total * 98 DIV 100"), F.col("val"))), F.lit(0))
    return run.agg(lo.alias("lo"), F.greatest(hi, lo + 1).alias("hi"))


def mosaic(panels: list[DataFrame], width: int, height: int) -> DataFrame:
    """Panels of equal size side by side in two columns, as (panel, i, j, val)."""
    moved = [p.select(F.lit(k).alias("panel"), (F.col("i") + (k // 2) * height).cast("int").alias("i"), (F.col("j") + (k % 2) * width).cast("int").alias("j"), "val") for k, p in enumerate(panels)]
    return reduce(DataFrame.unionByName, moved)


def panel_stats(panels: DataFrame) -> DataFrame:
    return panels.groupBy("panel").agg(F.count_if(F.col("val") > 0).alias("n_nonzero"), F.sum("val").cast("long").alias("total"), F.min("val").alias("least"), F.max("val").alias("most"))

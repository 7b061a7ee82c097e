"""Aggregations over voxel tables: levels of detail, occupancy, error metrics, histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import AXES
from ..functions.order import running
from .volume import with_cells


def decimate(voxels: DataFrame, factor: int = 2) -> DataFrame:
    """The next level of detail: rounded mean of the nonzero children; cells of air alone have no row."""
    keys = [F.expr(f"{a} DIV {factor}").cast("int").alias(a) for a in AXES]
    out = voxels.where("v > 0").groupBy(*keys).agg(F.sum("v").alias("_s"), F.count(F.lit(1)).alias("_c"))
    return out.select(*AXES, F.expr("(_s + _c DIV 2) DIV _c").cast("int").alias("v"))


def pyramid(voxels: DataFrame, dim: int, smallest: int) -> DataFrame:
    """All levels as (lod, z, y, x, v): level 0, then halves while the dimension stays at or above ``smallest``.

    Each level is made from the one before; a level has an eighth of the cells, so the plan's cost is the first's.
    """
    levels = [voxels.where("v > 0").select(F.lit(0).alias("lod"), *AXES, "v")]
    current, lod = voxels, 0
    while dim // 2 >= smallest:
        dim, lod = (dim + 1) // 2, lod + 1
        current = decimate(current)
        levels.append(current.select(F.lit(lod).alias("lod"), *AXES, "v"))
    return reduce(DataFrame.unionByName, levels)


def occupancy(voxels: DataFrame, chunk: int, block: int) -> DataFrame:
    """Present blocks of every chunk with their index in it and their rank among the present."""
    per = chunk // block
    b = with_cells(voxels.where("v > 0"), "b", block).select("bz", "by", "bx").distinct()
    parts = [F.expr(f"b{a} DIV {per}").cast("int").alias(f"c{a}") for a in AXES]
    index = reduce(lambda s, a: s * per + (F.col(f"b{a}") % per), AXES, F.lit(0))
    keyed = b.select(*parts, index.cast("int").alias("block_index"))
    w = Window.partitionBy("cz", "cy", "cx").orderBy("block_index")
    return keyed.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))


def prefix_offsets(lengths: DataFrame, keys: list[str], order: str, length: str) -> DataFrame:
    """Byte offset of every item: the running sum of the lengths before it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lengths.withColumn("offset", (F.sum(length).over(w) - F.col(length)).cast("long"))


def error_metrics(pairs: DataFrame) -> DataFrame:
    """MSE, PSNR, MAE over material, largest error and percentiles of (a, b), where either may be null for air.

    A percentile is the least error whose cumulative count reaches floor(p * n); it comes from the
    histogram of errors, which has 256 rows at most.
    """
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    e = pairs.select(F.abs(a - b).alias("e"), ((a > 0) | (b > 0)).alias("m"))
    hist = e.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.count_if("m").alias("nm"))
    running = hist.withColumn("cum", F.sum("n").over(Window.orderBy("e"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    marks = [F.min(F.when(F.col("cum") >= F.floor(F.lit(p / 100) * F.col("total")), F.col("e"))).cast("int").alias(f"p{p}") for p in (50, 90, 95, 99)]
    mse = F.sum(F.col("e") * F.col("e") * F.col("n")) / F.sum("n")
    out = running.agg(mse.alias("mse"), (F.sum(F.col("e") * F.col("nm")) / F.sum("nm")).alias("mae"), F.max(F.when(F.col("nm") > 0, F.col("e"))).cast("int").alias("max_error"), *marks)
    return out.withColumn("psnr", 10 * F.log10(255.0 * 255.0 / F.greatest("mse", F.lit(1e-12))))


def ssim(pairs: DataFrame, edge: int = 8) -> DataFrame:
    """Mean structural similarity over disjoint cubes of (z, y, x, a, b); every voxel of the volume has a row."""
    n = float(edge**3)
    keys = [F.expr(f"{c} DIV {edge}").alias(f"w{c}") for c in AXES]
    sums = pairs.groupBy(*keys).agg(*(F.sum(x).alias(name) for name, x in {"sa": F.col("a"), "sb": F.col("b"), "saa": F.col("a") * F.col("a"), "sbb": F.col("b") * F.col("b"), "sab": F.col("a") * F.col("b")}.items()))
    ma, mb = F.col("sa") / n, F.col("sb") / n
    va, vb, cab = F.col("saa") / n - ma * ma, F.col("sbb") / n - mb * mb, F.col("sab") / n - ma * mb
    c1, c2 = 6.5025, 58.5225
    return sums.agg(F.avg((2 * ma * mb + c1) * (2 * cab + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).alias("ssim"))


def histogram(voxels: DataFrame, value: Column) -> DataFrame:
    """Counts of values rounded to 0..255."""
    return voxels.groupBy(F.least(F.greatest(F.floor(value + 0.5), F.lit(0)), F.lit(255)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: Fixed values of the valley search: taps to each side, bins without a say, the range of peaks, their least share of
#: the highest, and the distance within which they are one.
SMOOTH, DEAD_BINS, FIRST_PEAK, LAST_PEAK, LEAST_SHARE, ONE_PEAK = 2, (0, 254, 255), 3, 252, 0.05, 10


def valley(counts: DataFrame) -> DataFrame:
    """One row (dark, light, valley, depth) from a histogram (bin, n): the two highest peaks and the lowest bin between; nulls without two.

    256 rows, whatever the volume. A peak is a bin of the smoothed histogram that no neighbour exceeds; of peaks that
    follow the last one kept closely only the higher is kept, which is a fold over the sorted peaks.
    """
    line = Window.partitionBy(F.lit(0)).orderBy("bin")
    bins = counts.sparkSession.range(256).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left")
    near = F.avg(F.coalesce("n", F.lit(0))).over(line.rowsBetween(-SMOOTH, SMOOTH))
    smooth = bins.select("bin", F.when(F.col("bin").isin(*DEAD_BINS), 0.0).otherwise(near).alias("h"))
    top = F.max("h").over(Window.partitionBy(F.lit(0)))
    peak = F.col("bin").between(FIRST_PEAK, LAST_PEAK) & (F.col("h") >= F.lag("h").over(line)) & (F.col("h") >= F.lead("h").over(line)) & (F.col("h") > LEAST_SHARE * top)
    whole = smooth.withColumn("peak", peak).agg(
        F.array_sort(F.collect_list(F.struct("bin", "h"))).alias("bins"),
        F.array_sort(F.collect_list(F.when(F.col("peak"), F.struct("bin", "h")))).alias("peaks"),
    )

    def keep(kept, p):
        last = F.try_element_at(kept, F.lit(-1))
        rest = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        close = F.coalesce(p["bin"] - last["bin"] <= ONE_PEAK, F.lit(False))
        return F.when(close & (p["h"] > last["h"]), F.concat(rest, F.array(p))).when(close, kept).otherwise(F.concat(kept, F.array(p)))

    none = F.expr("CAST(array() AS array<struct<bin: int, h: double>>)")
    highest = F.slice(F.array_sort(F.transform(F.aggregate("peaks", none, keep), lambda p: F.struct((-p["h"]).alias("low"), p["bin"].alias("bin"), p["h"].alias("h")))), 1, 2)
    two = whole.select("bins", highest.alias("two")).select("bins", "two", F.when(F.size("two") == 2, F.array_min("two.bin")).alias("dark"), F.when(F.size("two") == 2, F.array_max("two.bin")).alias("light"))
    between = F.filter("bins", lambda x: x["bin"].between(F.col("dark"), F.col("light")))
    found = two.select("dark", "light", "two", F.array_min(F.transform(between, lambda x: F.struct(x["h"].alias("h"), x["bin"].alias("bin")))).alias("low"))
    return found.select("dark", "light", F.col("low.bin").alias("valley"), (1 - F.col("low.h") / (F.array_min("two.h") + 1e-12)).alias("depth"))


def cut_level(valley: Column | str, floor_level: int = 39, strength: Column | float = 1.0) -> Column:
    """The air threshold: between the physical floor and the valley, the floor without a valley above it."""
    low = F.col(valley) if isinstance(valley, str) else valley
    return F.when(low > floor_level, F.floor(floor_level + strength * (low - floor_level) + 0.5)).otherwise(floor_level).cast("int")


def surface_stats(grid: DataFrame) -> DataFrame:
    """Mean depth and numbers of valid and invalid points of (gy, gx, pz, py, px, depth); null coordinates are invalid."""
    ok = F.col("pz").isNotNull()
    return grid.agg(F.avg(F.when(ok, F.col("depth"))).alias("mean_depth"), F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid"))


def quad_spacing(grid: DataFrame, gw: int, gh: int, most: int = 32) -> DataFrame:
    """Mean distance of horizontal neighbours at up to 32 probes along the grid's diagonal; 1.0 without any."""
    probes = min(gh, most)
    last = max(probes - 1, 1)
    at = grid.sparkSession.range(probes).select(F.expr(f"id * {gh - 1} DIV {last}").cast("int").alias("gy"), F.expr(f"id * {gw - 2} DIV {last}").cast("int").alias("gx"))
    a = at.join(grid.select("gy", "gx", *(F.col(c).alias(f"a_{c}") for c in ("pz", "py", "px"))), ["gy", "gx"])
    b = grid.select("gy", (F.col("gx") - 1).alias("gx"), *(F.col(c).alias(f"b_{c}") for c in ("pz", "py", "px")))
    d = reduce(Column.__add__, [F.pow(F.col(f"b_{c}") - F.col(f"a_{c}"), 2) for c in ("pz", "py", "px")])
    return a.join(b, ["gy", "gx"]).agg(F.coalesce(F.avg(F.sqrt(d)), F.lit(1.0)).alias("spacing"))


def covariance(points: DataFrame, cols=("x", "y", "z")) -> DataFrame:
    """Centroid, covariance sums and extent, in one pass over sums about the centroid found in a first."""
    mean = points.agg(*(F.avg(c).alias(f"m{c}") for c in cols))
    both = points.join(F.broadcast(mean))  # one row
    sums = [F.sum((F.col(a) - F.col(f"m{a}")) * (F.col(b) - F.col(f"m{b}"))).alias(f"s{a}{b}") for i, a in enumerate(cols) for b in cols[i:]]
    return both.agg(*(F.first(f"m{c}").alias(f"m{c}") for c in cols), *sums, *(F.min(c).alias(f"min_{c}") for c in cols), *(F.max(c).alias(f"max_{c}") for c in cols))


def rank_percentile(values: DataFrame, column: str, percents=(50, 90, 99)) -> DataFrame:
    """Values at index int(p / 100 * (n - 1)) of the sorted column, by counts of values rather than a sort of rows."""
    counts = values.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    run = running(counts, [F.col(column)], F.col("n"), "cum")
    total = run.agg(F.max("cum").alias("total"))  # one row
    return run.join(F.broadcast(total)).agg(*(F.min(F.when(F.col("cum") > F.floor(F.lit(p) * (F.col("total") - 1) / 100), F.col(column))).alias(f"p{p}") for p in percents))

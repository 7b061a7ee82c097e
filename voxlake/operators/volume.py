"""Lookups, range reads and predicates over voxel tables (z, y, x, v). A missing row is air."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import ABSENT, AXES, PRESENT, ZERO, cell_of, cells, dense_grid, shift_of, voxel_box
from ..functions.scratch import materialize

MASK64 = (1 << 64) - 1


def with_cells(voxels: DataFrame, prefix: str, edge: int) -> DataFrame:
    return voxels.select("*", *cells(prefix, edge))


def chunk_table(voxels: DataFrame, edge: int) -> DataFrame:
    """(cz, cy, cx, state, n_cells, n_material): what was fetched, and whether it is all air."""
    keys = ["cz", "cy", "cx"]
    out = with_cells(voxels, "c", edge).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("v") > 0).alias("n_material"))
    return out.select(*keys, F.when(F.col("n_material") > 0, PRESENT).otherwise(ZERO).alias("state"), "n_cells", "n_material")


def coverage(chunks: DataFrame, nz: int, ny: int, nx: int) -> DataFrame:
    """State of every chunk of a grid; chunks without a row were never fetched."""
    grid = dense_grid(chunks.sparkSession, nz, ny, nx).toDF("cz", "cy", "cx")
    return grid.join(chunks.select("cz", "cy", "cx", "state"), ["cz", "cy", "cx"], "left").select("cz", "cy", "cx", F.coalesce("state", F.lit(ABSENT)).alias("state"))


def resolve_chunks(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks asked for, with their state; out of bounds counts as absent."""
    return wanted.join(chunks.select("cz", "cy", "cx", "state"), ["cz", "cy", "cx"], "left").withColumn("state", F.coalesce("state", F.lit(ABSENT)))


def region(voxels: DataFrame, z0: int, y0: int, x0: int, dz: int, dy: int, dx: int) -> DataFrame:
    """A dense box: only its voxels are read, what is missing or outside is 0."""
    grid = dense_grid(voxels.sparkSession, dz, dy, dx)
    grid = grid.select(*((F.col(a) + lo).cast("int").alias(a) for a, lo in zip(AXES, (z0, y0, x0), strict=True)))
    found = voxels.where(voxel_box(z0, y0, x0, dz, dy, dx)).select(*AXES, "v")
    return grid.join(found, list(AXES), "left").select(*AXES, F.coalesce("v", F.lit(0)).alias("v"))


#: Voxels of boxes that a task unrolls, or so.
UNROLLED = 1 << 24


def regions(voxels: DataFrame, boxes: DataFrame, dz: int, dy: int, dx: int, edge: int) -> DataFrame:
    """Material voxels of many equal boxes (box_id, z0, y0, x0), in box coordinates.

    Boxes are cut into pieces of at most a block's edge. A block is packed with as much of the blocks above it as a piece that
    starts in it can reach, so a piece meets one row of bytes by an equi-join, and what is shuffled is a row a piece. Blocks where
    more pieces start than a task should unroll are dealt over salts, the others are sent once. A piece is then unrolled by
    generated code.
    """
    spark, dims = voxels.sparkSession, (dz, dy, dx)
    size = [min(n, edge) for n in dims]
    pieces = boxes.select("box_id", "z0", "y0", "x0")
    for a, n in zip(AXES, dims, strict=True):
        # The piece's first place in the box.
        pieces = pieces.withColumn(f"p{a}", F.lit(0) if n <= edge else F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(edge))))
    keys = ["bz", "by", "bx"]
    pieces = pieces.withColumns({f"b{a}": cell_of(F.col(f"{a}0") + F.col(f"p{a}"), edge) for a in AXES})
    # A block's pieces, as many as a task should have at most.
    most = max(UNROLLED // math.prod(size), 1)
    counts = materialize(pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "pieces")
    salts = F.ceil(F.col("n") / most).cast("int")
    total = counts.agg(F.sum("n")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-total // most))
    # No more rows than the pieces fill tasks.
    hot = F.broadcast(counts.where(F.col("n") > most).select(*keys, salts.alias("salts")))
    salt = F.pmod(F.xxhash64("box_id", "z0", "y0", "x0"), F.coalesce("salts", F.lit(1))).cast("int")
    dealt = pieces.join(hot, keys, "left").select("box_id", *(f"p{a}" for a in AXES), *((F.col(f"{a}0") + F.col(f"p{a}") - F.col(f"b{a}") * edge).alias(f"o{a}") for a in AXES), *keys, salt.alias("salt"))
    sent = _with_halo(voxels, counts, edge, size).select(*keys, "data", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    # The rows of a task are few, what it makes of them are many: the number of tasks can't be left to the rows' bytes.
    out = dealt.repartition(parts, *keys, "salt").join(sent.repartition(parts, *keys, "salt").hint("merge"), [*keys, "salt"])
    wide = [edge + n - 1 for n in size]
    for a, n, most in zip(AXES, dims, size, strict=True):
        last = F.lit(n - 1) if n <= edge else F.least(F.lit(n - 1) - F.col(f"p{a}"), F.lit(most - 1))
        out = out.withColumn(f"i{a}", F.explode(F.sequence(F.lit(0), last)))
    z, y, x = (F.col(f"o{a}") + F.col(f"i{a}") for a in AXES)
    out = out.withColumn("v", F.get("data", (z * wide[1] + y) * wide[2] + x).cast("int").bitwiseAND(F.lit(255))).where("v > 0")
    return out.select("box_id", *((F.col(f"p{a}") + F.col(f"i{a}")).alias(a) for a in AXES), "v")


def _with_halo(voxels: DataFrame, wanted: DataFrame, edge: int, size: list[int]) -> DataFrame:
    """(bz, by, bx, n, data): bytes of ``wanted`` blocks (bz, by, bx, n) and of what lies up to ``size`` - 1 beyond them, as numbers;
    128 to 255 come as negative ones. Blocks that have no material there have no row."""
    from .codec import pack_blocks

    wide = [edge + n - 1 for n in size]
    sides = [d for d in ((k >> 2 & 1, k >> 1 & 1, k & 1) for k in range(8)) if all(w > edge or not up for w, up in zip(wide, d, strict=True))]
    to = F.explode(F.array(*(F.struct(*((F.col(f"b{a}") - up).alias(f"b{a}") for a, up in zip(AXES, d, strict=True)), F.lit(4 * d[0] + 2 * d[1] + d[2]).alias("side")) for d in sides)))
    moved = pack_blocks(voxels, edge).select(to.alias("to"), "data").select("to.*", "data")
    keys = ["bz", "by", "bx"]
    lists = moved.join(wanted.select(*keys, "n"), keys).groupBy(*keys, "n").agg(F.collect_list(F.struct("side", "data")).alias("blocks"))
    each = max((1 << 26) // math.prod(wide), 1)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, each):
                small = batch.slice(lo, each)
                blocks = small.column(4)
                out = np.zeros((small.num_rows, *wide), np.int8)
                row = np.repeat(np.arange(small.num_rows), blocks.value_lengths().to_numpy(zero_copy_only=False))
                flat = blocks.flatten()
                for k, side, data in zip(row, flat.field(0).to_pylist(), flat.field(1), strict=True):
                    at = [up * edge for up in (side >> 2 & 1, side >> 1 & 1, side & 1)]
                    end = [min(a + edge, w) for a, w in zip(at, wide, strict=True)]
                    block = np.frombuffer(data.as_buffer(), np.int8).reshape(edge, edge, edge)
                    out[(k, *map(slice, at, end))] = block[tuple(slice(0, b - a) for a, b in zip(at, end, strict=True))]
                ends = np.arange(small.num_rows + 1, dtype=np.int32) * math.prod(wide)
                yield pa.RecordBatch.from_arrays([*(small.column(k) for k in range(4)), pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))], names=[*keys, "n", "data"])

    return lists.mapInArrow(run, "bz int, by int, bx int, n bigint, data array<tinyint>")


def block_stats(voxels: DataFrame, edge: int) -> DataFrame:
    """(bz, by, bx, present, material, nibble, fraction) of blocks that have a row.

    The nibble is (material * 15 + volume / 2) / volume in integers, 1 at least where there is any.
    """
    size = edge**3
    out = with_cells(voxels, "b", edge).groupBy("bz", "by", "bx").agg(F.count_if(F.col("v") > 0).alias("material"))
    nibble = F.expr(f"(material * 15 + {size // 2}) DIV {size}")
    nibble = F.when(F.col("material") > 0, F.greatest(nibble, F.lit(1))).otherwise(F.lit(0)).cast("int")
    out = out.withColumn("nibble", nibble)
    return out.select("bz", "by", "bx", (F.col("material") > 0).alias("present"), "material", "nibble", (F.col("nibble") / 15.0).alias("fraction"))


def candidate_boxes(seed: int, count: int, dims: tuple[int, int, int], box: tuple[int, int, int], attempts: int | None = None) -> list[tuple[int, int, int, int]]:
    """(attempt, z, y, x) of the seeded generator: 64-bit xorshift by 13, 7, 17; z, then y, then x by modulo."""
    state = seed & MASK64 or 0x9E3779B97F4A7C15
    out = []
    spans = [n - b + 1 for n, b in zip(dims, box, strict=True)]
    if min(spans) <= 0:
        return []
    for k in range(attempts if attempts is not None else 256 * count):
        at = []
        for span in spans:
            state ^= state << 13 & MASK64
            state ^= state >> 7
            state ^= state << 17 & MASK64
            at.append(state % span)
        out.append((k, *at))
    return out


def sample_boxes(voxels: DataFrame, candidates: list[tuple[int, int, int, int]], count: int, box: tuple[int, int, int], edge: int, min_fraction: float) -> DataFrame:
    """The first ``count`` candidates whose touched blocks have a mean material fraction of ``min_fraction``."""
    spark = voxels.sparkSession
    s = shift_of(edge)
    named = spark.createDataFrame(candidates, "attempt int, z0 int, y0 int, x0 int")
    touched = named
    for a, n in zip(AXES, box, strict=True):
        touched = touched.withColumn(f"b{a}", F.explode(F.sequence(F.shiftright(f"{a}0", s), F.shiftright(F.col(f"{a}0") + (n - 1), s))))
    fractions = block_stats(voxels, edge).select("bz", "by", "bx", "fraction")
    means = touched.join(fractions, ["bz", "by", "bx"], "left").groupBy("attempt", "z0", "y0", "x0").agg(F.avg(F.coalesce("fraction", F.lit(0.0))).alias("mean_fraction"))
    return means.where(F.col("mean_fraction") >= min_fraction).orderBy("attempt").limit(count)


def apply_cut(voxels: DataFrame, smoothed: str, cut: Column | int) -> Column:
    """The air mask: 0 below the cut; what survives is 1 at least."""
    return F.when(F.col(smoothed) < cut, F.lit(0)).otherwise(F.greatest(F.col("v"), F.lit(1)))


def voxel_hash(voxels: DataFrame, edge: int) -> DataFrame:
    """A hash per chunk that doesn't depend on row order: the exclusive or of its voxels' hashes."""
    keyed = with_cells(voxels, "c", edge)
    return keyed.groupBy("cz", "cy", "cx").agg(F.bit_xor(F.xxhash64("z", "y", "x", "v")).alias("hash"))


def corrupt_chunks(voxels: DataFrame, stored: DataFrame, edge: int) -> DataFrame:
    """Chunks whose contents don't have the stored hash, or that are missing."""
    now = voxel_hash(voxels, edge).withColumnRenamed("hash", "now")
    return stored.join(now, ["cz", "cy", "cx"], "left").where(~F.col("hash").eqNullSafe(F.col("now"))).select("cz", "cy", "cx")


def structure_ok(blocks: DataFrame, edge: int) -> DataFrame:
    """Blocks whose payload has another size than it should, or whose number is negative."""
    return blocks.where((F.octet_length("data") != edge**3) | (F.least("bz", "by", "bx") < 0))


def block_of(axis: str, edge: int) -> Column:
    return cell_of(axis, edge)

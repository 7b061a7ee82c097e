"""Coordinate arithmetic: blocks and chunks, Morton order, levels of detail.

Coordinates are INT in order z, y, x. Block and chunk numbers are arithmetic shifts, so they are
right for negative coordinates too, where DIV would round towards zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
BLOCK, CHUNK = 16, 256
ABSENT, PRESENT, ZERO = 0, 1, 2


def shift_of(edge: int) -> int:
    if edge <= 0 or edge & (edge - 1):
        raise ValueError("an edge must be a power of two")
    return edge.bit_length() - 1


def cell_of(coord: Column | str, edge: int) -> Column:
    """Number of the cell of ``edge`` voxels that a coordinate lies in."""
    return F.shiftright(F.col(coord) if isinstance(coord, str) else coord, shift_of(edge)).cast("int")


def cells(prefix: str, edge: int) -> list[Column]:
    """Cell numbers of z, y and x as columns named prefix + axis."""
    return [cell_of(a, edge).alias(prefix + a) for a in AXES]


def voxel_box(z0: int, y0: int, x0: int, dz: int, dy: int, dx: int) -> Column:
    """Voxels of a half-open box."""
    parts = [F.col(a).between(lo, lo + n - 1) for a, lo, n in zip(AXES, (z0, y0, x0), (dz, dy, dx), strict=True)]
    return reduce(Column.__and__, parts)


def block_box(z0: int, y0: int, x0: int, dz: int, dy: int, dx: int, edge: int = BLOCK, prefix: str = "b") -> Column:
    """Blocks that a box touches: a predicate on stored columns, so it reaches the Parquet scan."""
    s = shift_of(edge)
    parts = [F.col(prefix + a).between(lo >> s, (lo + n - 1) >> s) for a, lo, n in zip(AXES, (z0, y0, x0), (dz, dy, dx), strict=True)]
    return reduce(Column.__and__, parts)


def morton(z: Column, y: Column, x: Column, bits: int = 12) -> Column:
    """Interleaved bits, x lowest."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for k, c in enumerate((x, y, z)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1)), 3 * b + k))
    return out


def to_lod(coord: Column, lod: int) -> Column:
    """A level-0 coordinate at a level, kept at voxel centres."""
    return (coord + 0.5) / float(1 << lod) - 0.5


def to_u8(value: Column) -> Column:
    """Clamp to 0..255 and round half up, as an INT."""
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int")


def dense_grid(spark, nz: int, ny: int, nx: int):
    """All coordinates of a box from the origin, made in parallel."""
    i = F.col("id")
    return spark.range(nz * ny * nx).select(F.expr(f"id DIV {ny * nx}").cast("int").alias("z"), F.expr(f"(id DIV {nx}) % {ny}").cast("int").alias("y"), (i % nx).cast("int").alias("x"))

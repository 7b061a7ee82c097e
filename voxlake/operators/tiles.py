"""Volumes dealt into cubic tiles, one task's unit of work: keys, linear numbers, and groups that include empty tiles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.coords import AXES, cell_of, dense_grid

TILE = 32
KEYS = ["tz", "ty", "tx"]
KEYS_SQL = "tz int, ty int, tx int"
VOXEL = pa.schema([(a, pa.int32()) for a in AXES])


def tiled(voxels: DataFrame, tile: int) -> DataFrame:
    """(z, y, x) with the tile's numbers."""
    return voxels.select(*AXES, *(cell_of(a, tile).alias(f"t{a}") for a in AXES))


def tile_grid(spark, dims: tuple[int, int, int], tile: int) -> DataFrame:
    return dense_grid(spark, *(-(-n // tile) for n in dims)).toDF(*KEYS)


def key_of(key) -> tuple[int, int, int]:
    return tuple(k.as_py() for k in key)


def local(voxels: pa.Table, key: tuple[int, int, int], tile: int) -> tuple[np.ndarray, ...]:
    """Coordinates within the tile."""
    return tuple(voxels.column(a).to_numpy() - k * tile for a, k in zip(AXES, key, strict=True))


def box_of(voxels: pa.Table, key: tuple[int, int, int], tile: int) -> np.ndarray:
    """The tile's mask."""
    on = np.zeros((tile,) * 3, bool)
    on[local(voxels, key, tile)] = True
    return on


def inside(key: tuple[int, int, int], dims: tuple[int, int, int], tile: int) -> tuple[slice, ...]:
    """The part of a tile that lies in the volume."""
    return tuple(slice(0, min(tile, n - k * tile)) for k, n in zip(key, dims, strict=True))


def voxel_rows(at: np.ndarray, key: tuple[int, int, int], tile: int, **columns: np.ndarray) -> pa.Table:
    """Rows of local positions (n, 3) in global coordinates with further columns."""
    cols = {a: pa.array((at[:, k] + key[k] * tile).astype(np.int32)) for k, a in enumerate(AXES)}
    return pa.table(cols | {n: pa.array(c) for n, c in columns.items()})


def by_tile(left: DataFrame, right: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(key, left rows, right rows)`` for every tile that either table has."""
    return left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS)).applyInArrow(run, schema)

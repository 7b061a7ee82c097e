"""Exact distances by tiles: lower envelopes of line segments, merged from lists of parabolas.

The squared distance along a line is the lower envelope of parabolas f(j) + (i - j)^2. A line is cut into
the segments of its tiles. A tile makes the envelope of its own parabolas, and for either
side the list of those that can be lowest beyond its end, a few a line. Which tiles of a
column can matter to which is told by bounds of one number a line; the lists of those go to the tile and are
merged in. One axis after the other: no task holds more than a tile, its lists, or the bounds of a column of tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coords import AXES
from ..functions.scratch import materialize
from .tiles import KEYS, KEYS_SQL, TILE, box_of, by_tile, inside, key_of, tile_grid, tiled, voxel_rows

FAR = 1e12
BOUNDS = ("low", "at", "top")
PACKED = f"{KEYS_SQL}, d binary, low binary, at binary, top binary, up binary, down binary"
PARABOLA = np.dtype([("line", "<i4"), ("j", "<i4"), ("f", "<f8")])


def lower_envelope(f: np.ndarray) -> np.ndarray:
    """min over j of f[j] + (i - j)^2 along the last axis, exact; stops once no longer reach can improve."""
    out = f.copy()
    n = f.shape[-1]
    for d in range(1, n):
        if d * d >= out.max():
            break
        np.minimum(out[..., d:], f[..., :-d] + d * d, out=out[..., d:])
        np.minimum(out[..., :-d], f[..., d:] + d * d, out=out[..., :-d])
    return out


def beyond(f: np.ndarray, start: int) -> np.ndarray:
    """Parabolas of segments f (line, place) that can be lowest after the segment's end; positions count from ``start``.

    A parabola loses everywhere beyond the end to a later one that is not above it there.
    """
    lines, n = f.shape
    here = f + np.arange(n, 0, -1.0) ** 2
    later = np.full((lines, n), np.inf)
    later[:, :-1] = np.minimum.accumulate(here[:, :0:-1], 1)[:, ::-1]
    line, j = np.nonzero((here < later) & (f < FAR))
    out = np.empty(len(line), PARABOLA)
    out["line"], out["j"], out["f"] = line, start + j, f[line, j]
    return out


def before(f: np.ndarray, start: int) -> np.ndarray:
    """The same for what lies before the segment's first place."""
    out = beyond(f[:, ::-1], 0)
    out["j"] = start + f.shape[1] - 1 - out["j"]
    return out


def merged(own: np.ndarray, lists: list[np.ndarray], start: int) -> np.ndarray:
    """Segments ``own`` (line, place) lowered by the parabolas of other segments."""
    out = own.copy()
    for entries in lists:
        for lo in range(0, len(entries), 1 << 14):
            e = entries[lo : lo + (1 << 14)]
            e = e[np.argsort(e["line"], kind="stable")]
            values = e["f"][:, None] + (start + np.arange(own.shape[1]) - e["j"][:, None]) ** 2.0
            line, first = np.unique(e["line"], return_index=True)
            if len(line):
                out[line] = np.minimum(out[line], np.minimum.reduceat(values, first, 0))
    return out


def lines_of(box: np.ndarray, axis: int) -> np.ndarray:
    """A tile's lines along an axis (line, place)."""
    return np.moveaxis(box, axis, 2).reshape(-1, box.shape[axis])


def box_from(lines: np.ndarray, axis: int, tile: int) -> np.ndarray:
    return np.moveaxis(lines.reshape((tile,) * 3), 2, axis)


def _row(key, box: np.ndarray, axis: int, tile: int) -> pa.Table:
    """A tile ready for the merge along ``axis``: its own envelope, bounds and lists."""
    f, start = lines_of(box, axis), key[axis] * tile
    own = lower_envelope(f)
    at = f.argmin(1)
    values = {
        "d": own.tobytes(),
        "low": f[np.arange(len(f)), at].tobytes(),
        "at": (start + at).astype(np.float64).tobytes(),
        "top": own.max(1).tobytes(),
        "up": beyond(f, start).tobytes(),
        "down": before(f, start).tobytes(),
    }
    return pa.table({k: pa.array([v], pa.int32()) for k, v in zip(KEYS, key, strict=True)} | {k: pa.array([v], pa.binary()) for k, v in values.items()})


def relevant(low: np.ndarray, at: np.ndarray, top: np.ndarray, tile: int) -> list[tuple[int, int]]:
    """(segment, other segment) of a column (segment, line) where the other's parabolas can lower some place of the first."""
    n = len(low)
    best = np.where((low < FAR).any(0), top, -1.0)  # nothing can lower a line without any parabola
    starts = np.arange(n)[:, None] * tile
    for d in range(1, n):
        if ((d - 1) * tile + 1) ** 2 >= best.max():
            break
        # An upper bound of every place: the lowest parabola of another segment, at the place farthest from it.
        best[:-d] = np.minimum(best[:-d], low[d:] + (at[d:] - starts[:-d]) ** 2)
        best[d:] = np.minimum(best[d:], low[:-d] + (starts[d:] + tile - 1 - at[:-d]) ** 2)
    found = []
    for d in range(1, n):
        gap = ((d - 1) * tile + 1) ** 2
        if gap >= best.max():
            break
        found += [(s, s + d) for s in np.flatnonzero((low[d:] + gap < best[:-d]).any(1)).tolist()]
        found += [(s + d, s) for s in np.flatnonzero((low[:-d] + gap < best[d:]).any(1)).tolist()]
    return found


def _lists(tiles: DataFrame, axis: int, tile: int) -> DataFrame:
    """(tile, list): lists of parabolas for the tiles that they can lower."""
    along, others = KEYS[axis], [k for k in KEYS if k != KEYS[axis]]

    def run(key, rows):
        rows = rows.sort_by(along)
        first = rows.column(along)[0].as_py()
        low, at, top = (np.stack([np.frombuffer(b.as_py()) for b in rows.column(c)]) for c in BOUNDS)
        pairs = np.array(relevant(low, at - first * tile, top, tile), np.int32).reshape(-1, 2) + first
        cols = {along: pairs[:, 0].copy(), "other": pairs[:, 1].copy()} | {k: np.full(len(pairs), v.as_py(), np.int32) for k, v in zip(others, key, strict=True)}
        return pa.table({c: cols[c] for c in (*KEYS, "other")})

    pairs = tiles.select(*KEYS, *BOUNDS).groupBy(*others).applyInArrow(run, f"{KEYS_SQL}, other int")
    sides = tiles.select(*others, F.col(along).alias("other"), "up", "down")
    return pairs.join(sides, [*others, "other"]).select(*KEYS, F.when(F.col("other") < F.col(along), F.col("up")).otherwise(F.col("down")).alias("list"))


def distance_tiles(mask: DataFrame, dims: tuple[int, int, int], tile: int = TILE, to_air: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tiles merged along x and y, and the lists that their merge along z still needs."""

    def start(key, _, rows):
        key = key_of(key)
        here = inside(key, dims, tile)
        box = np.full((tile,) * 3, FAR)
        box[here] = np.where(box_of(rows, key, tile) != to_air, 0.0, FAR)[here]
        return _row(key, box, 2, tile)

    tiles = materialize(by_tile(tile_grid(mask.sparkSession, dims, tile), tiled(mask, tile), start, PACKED), "distance")
    for axis in (2, 1):
        tiles = materialize(by_tile(tiles.select(*KEYS, "d"), _lists(tiles, axis, tile), _next_axis(axis, tile), PACKED), "distance")
    return tiles.select(*KEYS, "d"), _lists(tiles, 0, tile)


def _next_axis(axis: int, tile: int):
    def step(key, packed, lists):
        key = key_of(key)
        return _row(key, finished(key, packed, lists, axis, tile), axis - 1, tile)

    return step


def finished(key, packed: pa.Table, lists: pa.Table, axis: int, tile: int) -> np.ndarray:
    own = np.frombuffer(packed.column("d")[0].as_py()).reshape(-1, tile)
    return box_from(merged(own, [np.frombuffer(b.as_py(), PARABOLA) for b in lists.column("list")], key[axis] * tile), axis, tile)


def squared_distance(mask: DataFrame, dims: tuple[int, int, int], tile: int = TILE) -> DataFrame:
    """(z, y, x, d2): exact squared distance of every voxel to the nearest set one; FAR if there is none."""

    def run(key, packed, lists):
        key = key_of(key)
        box = finished(key, packed, lists, 0, tile)[inside(key, dims, tile)]
        return voxel_rows(np.argwhere(np.ones(box.shape, bool)), key, tile, d2=np.minimum(box, FAR).ravel())

    return by_tile(*distance_tiles(mask, dims, tile), run, "z int, y int, x int, d2 double")


def distance(mask: DataFrame, dims: tuple[int, int, int], tile: int = TILE) -> DataFrame:
    return squared_distance(mask, dims, tile).select(*AXES, F.sqrt("d2").alias("d"))


def signed_distance(mask: DataFrame, dims: tuple[int, int, int], tile: int = TILE) -> DataFrame:
    """(z, y, x, d): outside the distance to the mask, inside minus the distance to the background. Both meet as packed tiles."""

    def last(key, packed, lists):
        key = key_of(key)
        return pa.table({k: pa.array([v], pa.int32()) for k, v in zip(KEYS, key, strict=True)} | {"d": pa.array([finished(key, packed, lists, 0, tile).tobytes()], pa.binary())})

    def run(key, out, inner):
        key = key_of(key)
        here = inside(key, dims, tile)
        to_mask, to_air = (np.minimum(np.frombuffer(t.column("d")[0].as_py()).reshape((tile,) * 3)[here], FAR) for t in (out, inner))
        d = np.where(to_mask > 0, np.sqrt(to_mask), -np.sqrt(to_air))
        return voxel_rows(np.argwhere(np.ones(d.shape, bool)), key, tile, d=d.ravel())

    both = [by_tile(*distance_tiles(mask, dims, tile, to_air), last, f"{KEYS_SQL}, d binary") for to_air in (False, True)]
    return by_tile(*both, run, "z int, y int, x int, d double")

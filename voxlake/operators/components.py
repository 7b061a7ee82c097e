"""Connected components of masks by tiles.

A tile's components are found in one NumPy pass over its runs along x. Tiles are stored packed, a row each:
a label per voxel, the parts (a component within a tile, named by the linear number of its
first voxel) and the tile's outer layers. Layers that lie opposite each other give the links
between parts, so the graph has an edge per pair of parts that touch across a tile's face, edge or corner and
none per voxel. What the graph finds goes back to the parts by a join, and voxels are unpacked last.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coords import AXES
from ..functions.order import ranked
from ..functions.scratch import materialize
from .graph import connected_components
from .tiles import KEYS, KEYS_SQL, TILE, box_of, by_tile, inside, key_of, tile_grid, tiled, voxel_rows

HALF26 = [d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]
HALF6 = [(0, 0, 1), (0, 1, 0), (1, 0, 0)]
PACKED = f"{KEYS_SQL}, labels binary, parts array<struct<k: int, part: long, size: long, open: boolean>>, layers array<struct<dz: int, dy: int, dx: int, side: int, part: binary>>"
LAYER = ["dz", "dy", "dx"]


# ---------------------------------------------------------------- within a tile


def _ends(d: int, n: int) -> tuple[slice, slice]:
    """Places of a line, and those ``d`` further on."""
    return slice(max(0, -d), n - max(0, d)), slice(max(0, d), n - max(0, -d))


def merge(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0 to n - 1 that each can reach over the links: larger roots are hung below smaller ones until none differ."""
    root = np.arange(n)
    while len(a):
        a, b = root[a], root[b]
        differ = a != b
        a, b = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(root, b, a)
        while ((up := root[root]) != root).any():
            root = up
    return root


def tile_labels(on: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """A label per voxel, from 1 in raster order of the components' first voxels (0: off), and those voxels' places."""
    first = on.copy()
    first[..., 1:] &= ~on[..., :-1]
    run = np.where(on, np.cumsum(first.ravel()).reshape(on.shape), 0)
    starts = np.flatnonzero(first)
    links = []
    for dz, dy, dx in HALF26 if diagonal else HALF6:
        if (dz, dy) != (0, 0):
            (za, zb), (ya, yb), (xa, xb) = (_ends(d, n) for d, n in zip((dz, dy, dx), on.shape, strict=True))
            a, b = run[za, ya, xa], run[zb, yb, xb]
            both = (a > 0) & (b > 0)
            links.append(np.unique(a[both] * (len(starts) + 1) + b[both]))
    links = np.unique(np.concatenate(links))
    roots = merge(len(starts) + 1, links // (len(starts) + 1), links % (len(starts) + 1))
    own, label = np.unique(roots[1:], return_inverse=True)
    return np.append(0, label + 1)[run].astype(np.int32), starts[own - 1]


def _layer(values: np.ndarray, d: tuple[int, int, int], side: int) -> np.ndarray:
    """The outer layer on the side that direction ``d`` leaves by (0) or comes in by (1)."""
    at = {0: slice(None), 1: -1 if side == 0 else 0, -1: 0 if side == 0 else -1}
    return values[tuple(at[k] for k in d)]


def pack(on: np.ndarray, key: tuple[int, int, int], tile: int, ny: int, nx: int, diagonal: bool, border: np.ndarray | None = None) -> pa.Table:
    """A tile's row; ``border`` marks voxels that make their part open."""
    labels, first = tile_labels(on, diagonal)
    at = [c + k * tile for c, k in zip(np.unravel_index(first, on.shape), key, strict=True)]
    names = np.append(0, (at[0].astype(np.int64) * ny + at[1]) * nx + at[2])
    sizes = np.bincount(labels.ravel(), minlength=len(names))
    open_ = np.zeros(len(names), bool)
    if border is not None:
        open_[np.unique(labels[border])] = True
    parts = [{"k": k, "part": int(names[k]), "size": int(sizes[k]), "open": bool(open_[k])} for k in range(1, len(names))]
    named, layers = names[labels] + (labels > 0), []  # from 1, so that 0 is off
    for d in HALF26 if diagonal else HALF6:
        for side in (0, 1):
            layer = np.ascontiguousarray(_layer(named, d, side))
            if layer.any():
                layers.append(dict(zip(LAYER, d, strict=True)) | {"side": side, "part": layer.tobytes()})
    return pa.Table.from_pylist([dict(zip(KEYS, key, strict=True)) | {"labels": labels.tobytes(), "parts": parts, "layers": layers}], _SCHEMA)


_SCHEMA = pa.schema(
    [(k, pa.int32()) for k in KEYS]
    + [
        ("labels", pa.binary()),
        ("parts", pa.list_(pa.struct([("k", pa.int32()), ("part", pa.int64()), ("size", pa.int64()), ("open", pa.bool_())]))),
        ("layers", pa.list_(pa.struct([*((c, pa.int32()) for c in LAYER), ("side", pa.int32()), ("part", pa.binary())]))),
    ]
)


# ---------------------------------------------------------------- across tiles


def links_of(tiles: DataFrame, tile: int, diagonal: bool) -> DataFrame:
    """(a, b): parts that touch across tiles. A group is the two layers of one meeting of tiles."""
    layers = tiles.select(*KEYS, F.explode("layers").alias("l")).select(*KEYS, "l.*")
    met = layers.select(*LAYER, *((F.col(k) - F.when(F.col("side") == 1, F.col(d)).otherwise(0)).alias(k) for k, d in zip(KEYS, LAYER, strict=True)), "side", "part")

    def run(key, rows):
        found = [np.zeros((0, 2), np.int64)]
        if rows.num_rows == 2:
            free = sum(d.as_py() == 0 for d in key[:3])
            a, b = (np.frombuffer(rows.column("part")[rows.column("side").to_pylist().index(s)].as_py(), np.int64).reshape((tile,) * free) for s in (0, 1))
            for shift in product((-1, 0, 1) if diagonal else (0,), repeat=free):
                ends = [_ends(d, tile) for d in shift]
                p, q = a[tuple(e[0] for e in ends)], b[tuple(e[1] for e in ends)]
                both = (p > 0) & (q > 0)
                found.append(np.unique(np.stack([p[both], q[both]], 1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0) - 1
        return pa.table({"a": pairs[:, 0].copy(), "b": pairs[:, 1].copy()})

    return met.groupBy(*LAYER, *KEYS).applyInArrow(run, "a long, b long")


def rooted(tiles: DataFrame, tile: int, diagonal: bool) -> DataFrame:
    """(tile, k, size, open, root): every part with its component's least linear number."""
    parts = tiles.select(*KEYS, F.explode("parts").alias("p")).select(*KEYS, "p.*")
    found = connected_components(links_of(tiles, tile, diagonal)).withColumnRenamed("node", "part")
    return materialize(parts.join(found, "part", "left").select(*KEYS, "k", "size", "open", F.coalesce("component", "part").alias("root")), "parts")


def mask_tiles(mask: DataFrame, ny: int, nx: int, tile: int) -> DataFrame:
    def run(key, rows):
        return pack(box_of(rows, key_of(key), tile), key_of(key), tile, ny, nx, True)

    return materialize(tiled(mask, tile).groupBy(*KEYS).applyInArrow(run, PACKED), "tiles")


def unpack(tiles: DataFrame, parts: DataFrame, tile: int, columns: dict[str, str]) -> DataFrame:
    """Voxels (z, y, x) of the parts that ``parts`` (tile, k) has, with its ``columns`` (name: type)."""

    def run(key, packed, wanted):
        key = key_of(key)
        labels = np.frombuffer(packed.column("labels")[0].as_py(), np.int32).reshape((tile,) * 3)
        k = wanted.column("k").to_numpy()
        place = np.full(labels.max() + 1, -1)
        place[k] = np.arange(len(k))
        at = np.argwhere(place[labels] >= 0)
        row = place[labels[tuple(at.T)]]
        return voxel_rows(at, key, tile, **{c: wanted.column(c).to_numpy()[row] for c in columns})

    there = tiles.select(*KEYS, "labels").join(parts.select(*KEYS).distinct(), KEYS, "left_semi")
    schema = "z int, y int, x int" + "".join(f", {c} {t}" for c, t in columns.items())
    return by_tile(there, parts.select(*KEYS, "k", *columns), run, schema)


# ---------------------------------------------------------------- operators


def numbered(parts: DataFrame) -> DataFrame:
    """Adds label: roots numbered from 1 in ascending order."""
    order = ranked(parts.select("root").distinct(), [F.col("root")], "label")
    return parts.join(order, "root").withColumn("label", F.col("label").cast("int"))


def label(mask: DataFrame, ny: int, nx: int, tile: int = TILE) -> DataFrame:
    """(z, y, x, root, label): 26-connected components; labels from 1 in raster order of their first voxel, whose linear number is the root.

    A mask without voxels has none.
    """
    tiles = mask_tiles(mask, ny, nx, tile)
    return unpack(tiles, numbered(rooted(tiles, tile, True)), tile, {"root": "long", "label": "int"})


def component_sizes(mask: DataFrame, ny: int, nx: int, tile: int = TILE) -> DataFrame:
    """(label, size) of all components; voxels are counted within their tiles."""
    parts = rooted(mask_tiles(mask, ny, nx, tile), tile, True)
    return numbered(parts.groupBy("root").agg(F.sum("size").alias("size"))).select("label", "size")


def remove_small(mask: DataFrame, ny: int, nx: int, least: int, tile: int = TILE) -> DataFrame:
    """The mask without components of fewer than ``least`` voxels."""
    tiles = mask_tiles(mask, ny, nx, tile)
    parts = rooted(tiles, tile, True)
    kept = parts.groupBy("root").agg(F.sum("size").alias("whole")).where(F.col("whole") >= least)
    return unpack(tiles, parts.join(kept, "root", "left_semi"), tile, {})


def fill_cavities(mask: DataFrame, dims: tuple[int, int, int], tile: int = TILE) -> DataFrame:
    """The mask with every background component that doesn't reach the border filled (6-connected). Air exists in tiles only, never as rows."""

    def run(key, _, rows):
        key = key_of(key)
        air = np.zeros((tile,) * 3, bool)
        air[inside(key, dims, tile)] = True
        air &= ~box_of(rows, key, tile)
        border = np.zeros_like(air)
        for axis, (k, n) in enumerate(zip(key, dims, strict=True)):
            for edge in (0, n - 1):
                if k == edge // tile:
                    border[(slice(None),) * axis + (edge % tile,)] = True
        return pack(air, key, tile, dims[1], dims[2], False, border & air)

    tiles = materialize(by_tile(tile_grid(mask.sparkSession, dims, tile), tiled(mask, tile), run, PACKED), "air")
    parts = rooted(tiles, tile, False)
    open_ = parts.where("open").select("root").distinct()
    return mask.select(*AXES).unionByName(unpack(tiles, parts.join(open_, "root", "left_anti"), tile, {}))

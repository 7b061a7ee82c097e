"""Zarr v2 levels: dense cubic chunks of bytes, raw or blosc with zstd.

A level is planned over a listing of its objects, so planning follows what is stored and never the grid.
Coordinates are parsed from keys, filters on them drop rows of the listing, and tasks fetch what is left: whole
chunks, or of each chunk the bytes that a box needs. A chunk without an object is air; an object that can't be
read fails the task, so that it is tried again.
"""

from __future__ import annotations

import itertools
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coords import AXES, PRESENT, ZERO, block_box, cells, dense_grid, shift_of
from .objects import ArrowStore, exists, listing, small_text

SCHEMA = "lod int, cz int, cy int, cx int, state int, data binary"
ARROW = pa.schema([(n, pa.int32()) for n in ("lod", "cz", "cy", "cx", "state")] + [("data", pa.binary())])
CHUNK = ["cz", "cy", "cx"]


def read_meta(text: str) -> dict:
    """Shape, chunk edge, separator and codec of a ``.zarray``; what isn't supported raises."""
    meta = json.loads(text)
    if meta.get("zarr_format") != 2:
        raise ValueError("only zarr version 2 is supported")
    if meta["dtype"] not in ("|u1", "<u1", "u1"):
        raise ValueError("only unsigned bytes are supported")
    edges = set(meta["chunks"])
    if len(edges) != 1 or len(meta["shape"]) != 3:
        raise ValueError("chunks must be cubes of three axes")
    compressor = meta.get("compressor")
    if compressor is not None and (compressor.get("id") != "blosc" or compressor.get("cname", "zstd") != "zstd"):
        raise ValueError("only raw chunks and blosc with zstd are supported")
    return {"shape": tuple(meta["shape"]), "edge": edges.pop(), "separator": meta.get("dimension_separator", "."), "codec": "raw" if compressor is None else "blosc"}


def blosc_decode(blob: bytes) -> bytes:
    """A blosc 1 frame of zstd blocks without shuffling: stored whole, or block by block."""
    _, _, flags, _, size, block, total = struct.unpack_from("<BBBBIII", blob)
    if flags & 0x05:
        raise ValueError("shuffled frames are not supported")
    if flags & 0x02:
        return blob[16 : 16 + size]
    count = -(-size // block)
    starts = struct.unpack_from(f"<{count}I", blob, 16)
    out = []
    for k, at in enumerate(starts):
        wanted = min(block, size - k * block)
        (n,) = struct.unpack_from("<I", blob, at)
        body = blob[at + 4 : at + 4 + n]
        out.append(body if n == wanted else zstandard.ZstdDecompressor().decompress(body, max_output_size=wanted))
    return b"".join(out)


def blosc_encode(data: bytes, block: int = 1 << 16) -> bytes:
    """The inverse, for writing fixtures and exports."""
    parts = [zstandard.ZstdCompressor(level=3).compress(data[k : k + block]) for k in range(0, len(data), block)]
    at, starts, body = 16 + 4 * len(parts), [], b""
    for p in parts:
        starts.append(at + len(body))
        body += struct.pack("<I", len(p)) + p
    frame = struct.pack(f"<{len(parts)}I", *starts) + body
    return struct.pack("<BBBBIII", 2, 1, 0x90, 1, len(data), block, 16 + len(frame)) + frame


def blosc_range(read, start: int, length: int) -> bytes:
    """Bytes start to start + length of a frame's contents; of the frame only its table and the blocks that hold them are read.

    ``read(start, length)`` gives bytes of the frame.
    """
    header = read(0, 16)
    _, _, flags, _, size, block, total = struct.unpack("<BBBBIII", header)
    if flags & 0x05:
        raise ValueError("shuffled frames are not supported")
    if flags & 0x02:
        return read(16 + start, length)
    count = -(-size // block)
    starts = [*struct.unpack(f"<{count}I", read(16, 4 * count)), total]
    first, last = start // block, (start + length - 1) // block
    body, out = read(starts[first], starts[last + 1] - starts[first]), []
    for k in range(first, last + 1):
        at, wanted = starts[k] - starts[first], min(block, size - k * block)
        (n,) = struct.unpack_from("<I", body, at)
        part = body[at + 4 : at + 4 + n]
        out.append(part if n == wanted else zstandard.ZstdDecompressor().decompress(part, max_output_size=wanted))
    return b"".join(out)[start - first * block :][:length]


# ---------------------------------------------------------------- planning


def geometry(spark: SparkSession, root: str, lod: int = 0) -> dict:
    """Shape, edge, codec, separator and chunk grid of a level."""
    text = small_text(spark, f"{root}/{lod}/.zarray")
    if text is None:
        raise FileNotFoundError(f"{root}/{lod}/.zarray")
    meta = read_meta(text)
    return {**meta, "grid": tuple(-(-n // meta["edge"]) for n in meta["shape"])}


def key_of(meta: dict, lod: int, z: int, y: int, x: int) -> str:
    """The key of a chunk's object, without fetching it."""
    return f"{lod}/" + meta["separator"].join(map(str, (z, y, x)))


def n_levels(spark: SparkSession, root: str) -> int:
    """Levels from 0 up to the first that is missing."""
    return next(k for k in itertools.count() if not exists(spark, f"{root}/{k}/.zarray"))


def stored(spark: SparkSession, root: str, lod: int = 0) -> DataFrame:
    """(lod, cz, cy, cx, key, length) of a level's objects, from their listing alone."""
    meta = geometry(spark, root, lod)
    parts = F.split("key", "[.]" if meta["separator"] == "." else "/")
    rows = listing(spark, f"{root}/{lod}").where(F.size(parts) == 3)
    return rows.select(F.lit(lod).alias("lod"), *(parts[k].cast("int").alias(c) for k, c in enumerate(CHUNK)), F.concat(F.lit(f"{lod}/"), "key").alias("key"), "length")


def missing(spark: SparkSession, root: str, lod: int = 0) -> DataFrame:
    """(cz, cy, cx) of the grid's chunks that have no object; the grid is made by tasks."""
    grid = dense_grid(spark, *geometry(spark, root, lod)["grid"]).toDF(*CHUNK)
    return grid.join(stored(spark, root, lod).select(*CHUNK), CHUNK, "left_anti")


# ---------------------------------------------------------------- reading


def fetched(rows: DataFrame, root: str, meta: dict, opened=ArrowStore) -> DataFrame:
    """Chunks (lod, cz, cy, cx, state, data) of rows of a listing, one in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]):
        store = opened(root)
        for batch in batches:
            for *at, key in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                raw = store.get(key)
                if raw is None:
                    raise FileNotFoundError(f"{root}/{key} was listed and is gone")
                data = raw if meta["codec"] == "raw" else blosc_decode(raw)
                if len(data) != meta["edge"] ** 3:
                    raise ValueError(f"chunk {key} has {len(data)} bytes")
                state = PRESENT if np.frombuffer(data, np.uint8).any() else ZERO
                columns = [*at, state, data if state == PRESENT else None]
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)

    return rows.select("lod", *CHUNK, "key").mapInArrow(run, SCHEMA)


def read_level(spark: SparkSession, root: str, lod: int = 0, where: str = "true") -> DataFrame:
    """Chunks of a level, those without an object as air; ``where`` is a condition on cz, cy and cx that is put to the listing."""
    meta = geometry(spark, root, lod)
    air = missing(spark, root, lod).where(where).select(F.lit(lod).alias("lod"), *CHUNK, F.lit(ZERO).alias("state"), F.lit(None).cast("binary").alias("data"))
    return fetched(stored(spark, root, lod).where(where), root, meta).unionByName(air)


def read_pyramid(spark: SparkSession, root: str) -> DataFrame:
    """All levels; what is in none of them is air."""
    out = None
    for lod in range(n_levels(spark, root)):
        level = read_level(spark, root, lod)
        out = level if out is None else out.unionByName(level)
    return out


def voxels(chunks: DataFrame, edge: int) -> DataFrame:
    """(lod, z, y, x, v) of the material voxels of dense chunks."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                z, y, x = np.nonzero(data := np.frombuffer(row["data"], np.uint8).reshape(edge, edge, edge))
                at = [pa.array((a + row[c] * edge).astype(np.int32)) for a, c in ((z, "cz"), (y, "cy"), (x, "cx"))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(z), row["lod"], np.int32)), *at, pa.array(data[z, y, x].astype(np.int32))], names=["lod", "z", "y", "x", "v"])

    return chunks.where(F.col("state") == PRESENT).mapInArrow(run, "lod int, z int, y int, x int, v int")


def region(spark: SparkSession, root: str, z0: int, y0: int, x0: int, dz: int, dy: int, dx: int, lod: int = 0, opened=ArrowStore) -> tuple[DataFrame, DataFrame]:
    """Material voxels (z, y, x, v) of a box, and (key, length, fetched) of the objects it needs.

    Of each chunk that the box touches only the bytes of its planes in the box are fetched: a range of a raw chunk, the
    blocks that hold the range of a compressed one.
    """
    meta = geometry(spark, root, lod)
    edge, box, size = meta["edge"], (z0, y0, x0), (dz, dy, dx)
    touched = stored(spark, root, lod).where(block_box(*box, *size, edge, "c"))

    def planes(store, key, at):
        """Bytes of the chunk's planes in the box, and the first plane."""
        lo, hi = max(z0 - at[0] * edge, 0), min(z0 + dz - at[0] * edge, edge)
        start, length = lo * edge * edge, (hi - lo) * edge * edge
        if meta["codec"] == "raw":
            data = store.get_range(key, start, length)
        else:
            data = blosc_range(lambda a, n: store.get_range(key, a, n), start, length)
        if data is None or len(data) != length:
            raise ValueError(f"chunk {key} is short")
        return np.frombuffer(data, np.uint8).reshape(hi - lo, edge, edge), lo

    def cut(batches):
        store = opened(root)
        for batch in batches:
            for *at, key in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data, lo = planes(store, key, at)
                k = np.nonzero(data)
                p = [k[a] + at[a] * edge + (lo if a == 0 else 0) for a in range(3)]
                ok = np.logical_and.reduce([(c >= b) & (c < b + n) for c, b, n in zip(p, box, size, strict=True)])
                yield pa.RecordBatch.from_arrays([*(pa.array(c[ok].astype(np.int32)) for c in p), pa.array(data[k][ok].astype(np.int32))], names=[*AXES, "v"])

    def cost(batches):
        for batch in batches:
            spent = []
            for *at, key in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                store = opened(root)
                planes(store, key, at)
                spent.append(store.fetched)
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4), pa.array(spent, pa.int64())], names=["key", "length", "fetched"])

    keys = touched.select(*CHUNK, "key", "length")
    return keys.mapInArrow(cut, "z int, y int, x int, v int"), keys.mapInArrow(cost, "key string, length long, fetched long")


# ---------------------------------------------------------------- writing


def write_level(rows: DataFrame, root: str, lod: int, shape: tuple[int, int, int], edge: int, codec: str = "raw", separator: str = ".", block: int = 1 << 16, opened=ArrowStore) -> int:
    """Writes voxels (z, y, x, v) as a level, a task a chunk; chunks of air have no object. Returns the number of objects."""
    shift_of(edge)  # a power of two
    compressor = None if codec == "raw" else {"id": "blosc", "cname": "zstd", "clevel": 3, "shuffle": 0}
    meta = {"zarr_format": 2, "shape": shape, "chunks": [edge] * 3, "dtype": "|u1", "compressor": compressor, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": separator}
    opened(root).put(f"{lod}/.zarray", json.dumps(meta).encode())

    def put(key, chunk):
        at = [k.as_py() for k in key]
        cube = np.zeros((edge,) * 3, np.uint8)
        cube[tuple(chunk.column(a).to_numpy() - k * edge for a, k in zip(AXES, at, strict=True))] = chunk.column("v").to_numpy()
        data = cube.tobytes()
        opened(root).put(key_of({"separator": separator}, lod, *at), data if codec == "raw" else blosc_encode(data, block))
        return pa.table({"n": [1]})

    placed = rows.where("v > 0").select(*AXES, "v", *cells("c", edge)).groupBy(*CHUNK).applyInArrow(put, "n long")
    return placed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

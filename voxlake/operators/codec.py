"""A lossy block codec with a bounded error: DCT, dead-zone quantisation, corrections.

A block is a cube of edge N (16) as N^3 bytes. The relational forms (a row per coefficient) serve
analysis; the Arrow kernels encode and decode whole batches of blocks at once. The payload is
levels and corrections as integers under zstd: the numeric contract (dc, levels, bound), not a bit format.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quality of the presets 0 to 7 and their names; the bound of preset k is 2**k.
PRESET_QUALITY = (0.5, 0.5, 1.0, 2.5, 6.0, 16.0, 32.0, 64.0)
PRESET_NAMES = ("archival", "master", "high", "balanced", "streaming", "fast", "ultrafast", "preview")
STREAMING = 4
DEAD_ZONE, RECONSTRUCT, STEP_POWER = 0.2, 0.2, 0.65


@dataclass(frozen=True)
class Codec:
    quality: float = 8.0
    max_error: int = 0

    @staticmethod
    def of(quality: float, max_error: int = 0) -> Codec:
        """Quality that isn't finite, positive and at most 1024 counts as 8."""
        return Codec(quality if math.isfinite(quality) and 0 < quality <= 1024 else 8.0, max(int(max_error), 0))

    @staticmethod
    def preset(level: int) -> Codec:
        level = level if 0 <= level < len(PRESET_QUALITY) else STREAMING
        return Codec(PRESET_QUALITY[level], 2**level)


@lru_cache(maxsize=8)
def dct_basis(n: int = 16) -> np.ndarray:
    """Orthonormal DCT-II: row k is c_k cos(pi (2 i + 1) k / 2 n)."""
    k, i = np.mgrid[:n, :n]
    b = np.cos(np.pi * (2 * i + 1) * k / (2 * n)) * math.sqrt(2 / n)
    b[0] = math.sqrt(1 / n)
    return b


def dct3(blocks: np.ndarray) -> np.ndarray:
    b = dct_basis(blocks.shape[-1])
    return np.einsum("zi,yj,xk,...ijk->...zyx", b, b, b, blocks, optimize=True)


def idct3(coefficients: np.ndarray) -> np.ndarray:
    b = dct_basis(coefficients.shape[-1])
    return np.einsum("iz,jy,kx,...ijk->...zyx", b, b, b, coefficients, optimize=True)


@lru_cache(maxsize=32)
def steps(n: int, quality: float) -> np.ndarray:
    z, y, x = np.mgrid[:n, :n, :n]
    return quality * (1.0 + z + y + x) ** STEP_POWER


def quantise(c: np.ndarray, step: np.ndarray) -> np.ndarray:
    return (np.sign(c) * np.floor(np.abs(c) / step + DEAD_ZONE)).astype(np.int32)


def dequantise(level: np.ndarray, step: np.ndarray) -> np.ndarray:
    return np.sign(level) * step * (np.abs(level) + RECONSTRUCT * (level != 0))


# ---------------------------------------------------------------- blocks


def encode_blocks(blocks: np.ndarray, codec: Codec) -> list[bytes | None]:
    """Payload of each block of (m, n, n, n) values 0..255; a block of zeros has none.

    dc is the rounded mean of all voxels. Where the decoded value is further off than the bound,
    the excess is stored, so the bound holds for every voxel.
    """
    n = blocks.shape[-1]
    work = blocks.astype(np.float64)
    dc = np.floor(work.mean((1, 2, 3)) + 0.5)
    step = steps(n, codec.quality)
    levels = quantise(dct3(work - dc[:, None, None, None]), step)
    out: list[bytes | None] = []
    decoded = _decoded(levels, dc, step) if codec.max_error else None
    for k, block in enumerate(blocks):
        if not block.any():
            out.append(None)
            continue
        flat = levels[k].ravel().astype("<i4")
        last = int(np.flatnonzero(flat)[-1]) + 1 if flat.any() else 0
        fixes = b""
        if decoded is not None:
            off = block.astype(np.int32) - decoded[k]
            at = np.flatnonzero(np.abs(off.ravel()) > codec.max_error)
            excess = off.ravel()[at]
            fixes = at.astype("<u2").tobytes() + (np.sign(excess) * (np.abs(excess) - codec.max_error)).astype("<i2").tobytes()
        body = struct.pack("<BHH", int(dc[k]), last, len(fixes) // 4) + flat[:last].tobytes() + fixes
        out.append(zstandard.ZstdCompressor(level=3).compress(body))
    return out


def _decoded(levels: np.ndarray, dc: np.ndarray, step: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(idct3(dequantise(levels, step)) + dc[:, None, None, None] + 0.5), 0, 255).astype(np.int32)


def decode_blocks(payloads: list[bytes | None], codec: Codec, n: int = 16) -> np.ndarray:
    levels, dc = np.zeros((len(payloads), n**3), np.int32), np.zeros(len(payloads))
    fixes: list[tuple[int, np.ndarray, np.ndarray]] = []
    live = np.zeros(len(payloads), bool)
    for k, payload in enumerate(payloads):
        if payload is None:
            continue
        body = zstandard.ZstdDecompressor().decompress(payload)
        dc[k], last, m = struct.unpack_from("<BHH", body)
        if len(body) != 5 + 4 * last + 4 * m or last > n**3:
            raise ValueError("a block's payload is damaged")
        live[k] = True
        levels[k, :last] = np.frombuffer(body, "<i4", last, 5)
        if m:
            fixes.append((k, np.frombuffer(body, "<u2", m, 5 + 4 * last).astype(np.int64), np.frombuffer(body, "<i2", m, 5 + 4 * last + 2 * m).astype(np.int32)))
    out = _decoded(levels.reshape(-1, n, n, n), dc, steps(n, codec.quality)).reshape(len(payloads), -1)
    for k, at, value in fixes:
        out[k, at] += value
    out[~live] = 0
    return np.clip(out, 0, 255).astype(np.uint8).reshape(-1, n, n, n)


def pack_blocks(voxels: DataFrame, edge: int = 16) -> DataFrame:
    """(bz, by, bx, data): blocks with material as edge^3 bytes, gathered by one grouping."""
    from .volume import with_cells

    at = (F.col("z") % edge * edge + F.col("y") % edge) * edge + F.col("x") % edge

    def run(batches):
        for batch in batches:
            data = []
            for idx, val in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                block = np.zeros(edge**3, np.uint8)
                block[idx] = val
                data.append(block.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(data, pa.binary())], names=["bz", "by", "bx", "data"])

    cells = with_cells(voxels.where("v > 0"), "b", edge).select("bz", "by", "bx", F.struct(at.cast("int").alias("i"), "v").alias("c"))
    lists = cells.groupBy("bz", "by", "bx").agg(F.collect_list("c").alias("c")).select("bz", "by", "bx", F.col("c.i").alias("i"), F.col("c.v").alias("v"))
    return lists.mapInArrow(run, "bz int, by int, bx int, data binary")


def unpack_blocks(blocks: DataFrame, edge: int = 16) -> DataFrame:
    """(z, y, x, v) of material voxels of blocks (bz, by, bx, data)."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                small = batch.slice(k, 256)
                data = np.frombuffer(b"".join(small.column(3).to_pylist()), np.uint8).reshape(-1, edge, edge, edge)
                b, z, y, x = np.nonzero(data)
                origin = [small.column(c).to_numpy(zero_copy_only=False)[b] * edge for c in range(3)]
                yield pa.RecordBatch.from_arrays([*(pa.array((o + a).astype(np.int32)) for o, a in zip(origin, (z, y, x), strict=True)), pa.array(data[b, z, y, x].astype(np.int32))], names=["z", "y", "x", "v"])

    return blocks.select("bz", "by", "bx", "data").mapInArrow(run, "z int, y int, x int, v int")


def byte_pairs(blocks: DataFrame) -> DataFrame:
    """(v, u): bytes of ``data`` and ``decoded`` side by side."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                pair = [np.frombuffer(b"".join(batch.column(c).slice(k, 256).to_pylist()), np.uint8).astype(np.int32) for c in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(p) for p in pair], names=["v", "u"])

    return blocks.select("data", "decoded").mapInArrow(run, "v int, u int")


def quality_metrics(pairs: DataFrame) -> DataFrame:
    """One row (psnr, ssim) of voxel pairs (v, u): over all of them, SSIM with its usual constants for 255 levels."""
    t = pairs.agg(F.avg(F.pow(F.col("v") - F.col("u"), 2)).alias("mse"), F.avg("v").alias("a"), F.avg("u").alias("b"), F.var_pop("v").alias("va"), F.var_pop("u").alias("vb"), F.covar_pop("v", "u").alias("c"))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    a, b = F.col("a"), F.col("b")
    ssim = (2 * a * b + c1) * (2 * F.col("c") + c2) / ((a * a + b * b + c1) * (F.col("va") + F.col("vb") + c2))
    return t.select(F.round(10 * F.log10(65025 / F.col("mse")), 1).alias("psnr"), F.round(ssim, 2).alias("ssim"))


def _per_batch(df: DataFrame, column: str, out: str, convert, edge: int) -> DataFrame:
    others = [c for c in df.columns if c != column]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != column] + [f"{out} binary"])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                small = batch.slice(k, 128)
                values = convert(small.column(small.schema.get_field_index(column)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(small.column(small.schema.get_field_index(c)) for c in others), pa.array(values, pa.binary())], names=[*others, out])

    return df.mapInArrow(run, schema)


def encode(blocks: DataFrame, codec: Codec, edge: int = 16) -> DataFrame:
    """``data`` becomes ``payload``."""
    return _per_batch(blocks, "data", "payload", lambda v: encode_blocks(np.frombuffer(b"".join(v), np.uint8).reshape(-1, edge, edge, edge), codec), edge)


def decode(blocks: DataFrame, codec: Codec, edge: int = 16) -> DataFrame:
    """``payload`` becomes ``data``."""
    return _per_batch(blocks, "payload", "data", lambda v: [b.tobytes() for b in decode_blocks(v, codec, edge)], edge)


def residual_bytes(off: np.ndarray) -> bytes | None:
    """What a decoded block lacks, sparsely: gaps between positions and values as floats; None if nothing."""
    flat = off.ravel()
    at = np.flatnonzero(flat)
    if not len(at):
        return None
    return zstandard.ZstdCompressor(level=3).compress(np.diff(at, prepend=0).astype("<u2").tobytes() + flat[at].astype("<f4").tobytes())


def add_residual(block: np.ndarray, body: bytes) -> np.ndarray:
    """A decoded block with its residual added."""
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = len(raw) // 6
    out = block.astype(np.float64).ravel()
    out[np.frombuffer(raw, "<u2", n).astype(np.int64).cumsum()] += np.frombuffer(raw, "<f4", n, 2 * n)
    return np.clip(out, 0, 255).astype(np.uint8).reshape(block.shape)


def encode_exact(blocks: DataFrame, codec: Codec, edge: int = 16) -> DataFrame:
    """(bz, by, bx, payload, residual): a lossy payload, and beside it what makes the block exact."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                small = batch.slice(k, 128)
                data = np.frombuffer(b"".join(small.column(3).to_pylist()), np.uint8).reshape(-1, edge, edge, edge)
                payload = encode_blocks(data, codec)
                back = decode_blocks(payload, codec, edge)
                residual = [residual_bytes(a.astype(np.int16) - b) for a, b in zip(data, back, strict=True)]
                yield pa.RecordBatch.from_arrays([*(small.column(c) for c in range(3)), pa.array(payload, pa.binary()), pa.array(residual, pa.binary())], names=["bz", "by", "bx", "payload", "residual"])

    return blocks.select("bz", "by", "bx", "data").mapInArrow(run, "bz int, by int, bx int, payload binary, residual binary")


def decode_mixed(blocks: DataFrame, max_error: int = 0, edge: int = 16, tolerant: bool = False) -> DataFrame:
    """``payload`` becomes ``data``, each block by the quality in its row, however many qualities there are; a residual beside it is added.

    A damaged payload raises, or with ``tolerant`` has null data.
    """

    def one_by_one(payload, codec):
        out = []
        for p in payload:
            try:
                out.append(decode_blocks([p], codec, edge)[0])
            except (ValueError, struct.error, zstandard.ZstdError):
                out.append(None)
        return out

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                small = batch.slice(k, 128)
                quality = small.column(3).to_numpy(zero_copy_only=False)
                payload, residual = small.column(4).to_pylist(), small.column(5).to_pylist()
                data: list = [None] * len(payload)
                for q in np.unique(quality):
                    at = np.flatnonzero(quality == q)
                    codec, some = Codec.of(float(q), max_error), [payload[i] for i in at]
                    for i, block in zip(at.tolist(), one_by_one(some, codec) if tolerant else decode_blocks(some, codec, edge), strict=True):
                        if block is not None:
                            data[i] = (block if residual[i] is None else add_residual(block, residual[i])).tobytes()
                yield pa.RecordBatch.from_arrays([*(small.column(c) for c in range(3)), pa.array(data, pa.binary())], names=["bz", "by", "bx", "data"])

    residual = F.col("residual") if "residual" in blocks.columns else F.lit(None).cast("binary")
    return blocks.select("bz", "by", "bx", "quality", "payload", residual.alias("residual")).mapInArrow(run, "bz int, by int, bx int, data binary")


def quality_for_ratio(blocks: DataFrame, codec: Codec, ratio: float, edge: int = 16) -> float:
    """Quality that should reach a ratio, from the blocks on one diagonal per chunk: q (estimate / wanted)^(1 / 0.75), within 0.5 to 24."""
    per = 256 // edge
    sampled = blocks.where((F.col("bz") + F.col("by")) % per == F.col("bx") % per)
    row = encode(sampled, codec, edge).agg(F.sum(F.coalesce(F.octet_length("payload"), F.lit(0))).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    if not row["n"]:
        return codec.quality
    estimate, wanted = row["bytes"] / row["n"], edge**3 / ratio
    return min(max(codec.quality * (estimate / wanted) ** (1 / 0.75), 0.5), 24.0)


# ---------------------------------------------------------------- relational forms


def basis_table(spark, n: int) -> DataFrame:
    """(k, i, c): n^2 rows of the DCT basis, made from its formula."""
    rows = spark.range(n * n).select(F.expr(f"id DIV {n}").cast("int").alias("k"), (F.col("id") % n).cast("int").alias("i"))
    scale = F.when(F.col("k") == 0, math.sqrt(1 / n)).otherwise(math.sqrt(2 / n))
    return rows.withColumn("c", scale * F.cos(math.pi * (2 * F.col("i") + 1) * F.col("k") / (2.0 * n)))


def transform_rows(rows: DataFrame, keys: list[str], n: int, inverse: bool = False) -> DataFrame:
    """3-D DCT of (keys, z, y, x, f), axis by axis; the basis has n^2 rows, so it is broadcast."""
    basis = basis_table(rows.sparkSession, n)
    for axis in ("z", "y", "x"):
        b = basis.select(F.col("i" if not inverse else "k").alias(axis), F.col("k" if not inverse else "i").alias("_o"), "c")
        others = [a for a in ("z", "y", "x") if a != axis]
        rows = rows.join(F.broadcast(b), axis).groupBy(*keys, *others, "_o").agg(F.sum(F.col("f") * F.col("c")).alias("f")).withColumnRenamed("_o", axis)
    return rows.select(*keys, "z", "y", "x", "f")


def step_column(quality: float) -> Column:
    return quality * F.pow(1.0 + F.col("z") + F.col("y") + F.col("x"), F.lit(STEP_POWER))


def level_column(f: Column, step: Column) -> Column:
    return (F.signum(f) * F.floor(F.abs(f) / step + DEAD_ZONE)).cast("int")


def value_column(level: Column, step: Column) -> Column:
    return F.when(level == 0, 0.0).otherwise(F.signum(level) * step * (F.abs(level) + RECONSTRUCT))


def correction_column(original: Column, decoded: Column, bound: int) -> Column:
    """The excess of the error over the bound, null where the bound holds."""
    off = original - decoded
    return F.when(F.abs(off) > bound, (F.signum(off) * (F.abs(off) - bound)).cast("int"))


def train_priors(levels: DataFrame, n_bands: int = 8, top: int = 45) -> DataFrame:
    """(band, p): frequency of zero levels by band of z + y + x, in 1/4096 within 32..4064."""
    band = F.least((F.col("z") + F.col("y") + F.col("x")) * n_bands / float(top + 1), F.lit(n_bands - 1.0)).cast("int")
    share = F.avg(F.when(F.col("level") == 0, 1.0).otherwise(0.0))
    return levels.groupBy(band.alias("band")).agg(F.least(F.greatest(F.floor(share * 4096 + 0.5), F.lit(32)), F.lit(4064)).cast("int").alias("p"))


def scan_order(spark, n: int) -> DataFrame:
    """Coefficients in order of z + y + x, then linear index."""
    from pyspark.sql import Window

    rows = spark.range(n**3).select(F.col("id").cast("int").alias("index"), (F.expr(f"id DIV {n * n}") + F.expr(f"(id DIV {n}) % {n}") + F.col("id") % n).cast("int").alias("l1"))
    return rows.withColumn("rank", (F.row_number().over(Window.orderBy("l1", "index")) - 1).cast("int"))


def deblock(dense: DataFrame, quality: float, edge: int = 16) -> DataFrame:
    """Smooths block faces of dense (z, y, x, v) along x, then y, then z.

    Only the two voxels on either side of a face look at each other and one further; real edges
    (a difference of beta or more) and air stay. ``lag`` and ``lead`` over lines reach them.
    """
    from .segment import line_window

    beta, most = int(3.0 * quality + 6.0), int(0.5 * quality + 1.0)
    for axis in ("x", "y", "z"):
        w = line_window(axis)
        v, at = F.col("v"), F.col(axis) % edge
        near = {k: F.lead("v", k).over(w) for k in (1, 2)} | {-k: F.lag("v", k).over(w) for k in (1, 2)}
        right, left = (at == 0) & (F.col(axis) > 0), (at == edge - 1) & near[1].isNotNull()

        def fixed(p1, p0, q0, q1, low):
            p, q = F.when(F.coalesce(p1, F.lit(0)) > 0, p1).otherwise(p0), F.when(F.coalesce(q1, F.lit(0)) > 0, q1).otherwise(q0)
            delta = F.shiftright(4 * (q0 - p0) + (p - q) + 4, 3)
            delta = F.least(F.greatest(delta, F.lit(-most)), F.lit(most))
            moved = p0 + delta if low else q0 - delta
            keep = (p0 == 0) | (q0 == 0) | (F.abs(q0 - p0) >= beta)
            return F.when(keep, p0 if low else q0).otherwise(F.least(F.greatest(moved, F.lit(1)), F.lit(255)))

        out = F.when(left, fixed(near[-1], v, near[1], near[2], True)).when(right, fixed(near[-2], near[-1], v, near[1], False)).otherwise(v)
        dense = dense.select("z", "y", "x", out.cast("int").alias("v"))
    return dense

"""Queries of the codec: transforms, quantisation, bounds, presets."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.scratch import materialize
from ..operators import codec as B
from ..operators import segment as P
from ..operators import volume as V
from ..sources.volumes import grid_sql, read_table, vox, vox_sql
from .register import query

N = 4
BLOCKS = f"""blk AS (SELECT vec_id, CAST((i - 1) // 16 AS INTEGER) AS z, CAST((i - 1) // 4 % 4 AS INTEGER) AS y, CAST((i - 1) % 4 AS INTEGER) AS x, CAST(e AS DOUBLE) * 100 AS f
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))"""
BASIS = f"basis AS (SELECT k, i, CASE WHEN k = 0 THEN {math.sqrt(1 / N)!r} ELSE {math.sqrt(2 / N)!r} END * cos({math.pi!r} * (2 * i + 1) * k / {2.0 * N!r}) AS c FROM range({N}) a(k), range({N}) b(i))"
DCT = f"""{BLOCKS}, {BASIS}, dz AS (SELECT vec_id, k AS z, y, x, sum(f * c) AS f FROM blk JOIN basis ON i = z GROUP BY vec_id, k, y, x), dy AS (SELECT vec_id, z, k AS y, x, sum(f * c) AS f FROM dz JOIN basis ON i = y GROUP BY vec_id, z, k, x),
dct AS (SELECT vec_id, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(k AS INTEGER) AS x, sum(f * c) AS f FROM dy JOIN basis ON i = x GROUP BY vec_id, z, y, k)"""
STEP = "(6.0e0 * pow(1.0e0 + z + y + x, 0.65e0))"
LEVEL = f"CAST(sign(f) * floor(abs(f) / {STEP} + 0.2e0) AS INTEGER)"


def blocks(spark, sf):
    e = read_table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return e.select("vec_id", F.expr("CAST(i DIV 16 AS INT)").alias("z"), F.expr("CAST((i DIV 4) % 4 AS INT)").alias("y"), (F.col("i") % 4).cast("int").alias("x"), (F.col("e").cast("double") * 100).alias("f"))


def coefficients(spark, sf):
    return B.transform_rows(blocks(spark, sf), ["vec_id"], N)


@query("b3_dct_forward", f"WITH {DCT} SELECT vec_id, z, y, x, round(f, 4) + 0 AS f FROM dct")
def b3(spark, sf):
    return coefficients(spark, sf).select("vec_id", "z", "y", "x", (F.round("f", 4) + F.lit(0.0)).alias("f"))


@query("b3_dct_inverse", f"WITH {BLOCKS} SELECT vec_id, z, y, x, round(f, 3) + 0 AS f FROM blk")
def b3i(spark, sf):
    """Forward and back: the blocks themselves."""
    back = B.transform_rows(coefficients(spark, sf), ["vec_id"], N, inverse=True)
    return back.select("vec_id", "z", "y", "x", (F.round("f", 3) + F.lit(0.0)).alias("f"))


@query("b4_quantise", f"WITH {DCT} SELECT vec_id, z, y, x, {LEVEL} AS level FROM dct")
def b4(spark, sf):
    return coefficients(spark, sf).select("vec_id", "z", "y", "x", B.level_column(F.col("f"), B.step_column(6.0)).alias("level"))


@query("b5_dequantise", f"WITH {DCT}, l AS (SELECT vec_id, z, y, x, {LEVEL} AS level FROM dct) SELECT vec_id, z, y, x, round(CASE WHEN level = 0 THEN 0.0e0 ELSE sign(level) * {STEP} * (abs(level) + 0.2e0) END, 4) AS f FROM l")
def b5(spark, sf):
    return b4(spark, sf).select("vec_id", "z", "y", "x", F.round(B.value_column(F.col("level"), B.step_column(6.0)), 4).alias("f"))


@query("b6_max_error", f"WITH vox AS ({vox_sql(32)}), q AS (SELECT z, y, x, v, least(255, ((v + 8) // 16) * 16) AS r FROM vox) SELECT z, y, x, CAST(sign(v - r) * (abs(v - r) - 5) AS INTEGER) AS correction FROM q WHERE abs(v - r) > 5")
def b6(spark, sf):
    r = F.expr("least(255, ((v + 8) DIV 16) * 16)")
    return vox(spark, sf).select("z", "y", "x", B.correction_column(F.col("v"), r, 5).alias("correction")).where("correction IS NOT NULL")


#: Two neighbouring orthonormal DCTs by axis are the identity, so the error of a quantised block is that of its coefficients.
_N = 4


def _basis_sql(n: int) -> str:
    return f"d AS (SELECT k, i, CASE WHEN k = 0 THEN sqrt(1.0e0 / {n}) ELSE sqrt(2.0e0 / {n}) END * cos(pi() * (2 * i + 1) * k / {2 * n}) AS c FROM range({n}) a(k), range({n}) b(i))"


_BASIS = _basis_sql(_N)


def _axis_sql(source: str, axis: str, tag: str, inverse: bool = False, keys: str = "bz, by_, bx") -> str:
    others = [a for a in "zyx" if a != axis]
    at, on = ("i", "k") if inverse else ("k", "i")
    cols = ", ".join(f"d.{at} AS {a}" if a == axis else f"s.{a} AS {a}" for a in "zyx")
    return f"{tag} AS (SELECT {keys}, {cols}, sum(s.f * d.c) AS f FROM {source} s JOIN d ON d.{on} = s.{axis} GROUP BY {keys}, {', '.join('s.' + a for a in others)}, d.{at})"


_M, _OF = 16, "preset, bz, by_, bx"
_PRESETS = "p(preset, quality, bound) AS (VALUES " + ", ".join(f"({k}, {B.Codec.preset(k).quality!r}e0, {B.Codec.preset(k).max_error})" for k in (2, 4, 6)) + ")"


@query("b1_encode_decode_bound", f"""WITH vox AS (SELECT * FROM ({vox_sql(64)}) WHERE v > 0), b AS (SELECT DISTINCT z // {_M} AS bz, y // {_M} AS by_, x // {_M} AS bx FROM vox), {_PRESETS},
g AS (SELECT bz, by_, bx, a.i AS z, e.i AS y, h.i AS x FROM b, range({_M}) a(i), range({_M}) e(i), range({_M}) h(i)),
w AS (SELECT g.*, coalesce(v, 0) AS v FROM g LEFT JOIN vox ON vox.z = bz * {_M} + g.z AND vox.y = by_ * {_M} + g.y AND vox.x = bx * {_M} + g.x),
m AS (SELECT bz, by_, bx, floor(avg(v) + 0.5) AS dc FROM w GROUP BY 1, 2, 3), s AS (SELECT w.bz, w.by_, w.bx, w.z, w.y, w.x, v - dc AS f FROM w JOIN m USING (bz, by_, bx)), {_basis_sql(_M)},
{_axis_sql("s", "z", "f1")}, {_axis_sql("f1", "y", "f2")}, {_axis_sql("f2", "x", "f3")},
l AS (SELECT f3.*, p.*, quality * pow(1.0e0 + z + y + x, 0.65) AS step FROM f3, p), q AS (SELECT *, sign(f) * floor(abs(f) / step + 0.2) AS level FROM l),
r AS (SELECT preset, bz, by_, bx, z, y, x, CASE WHEN level = 0 THEN 0 ELSE sign(level) * step * (abs(level) + 0.2) END AS f FROM q),
{_axis_sql("r", "z", "i1", True, _OF)}, {_axis_sql("i1", "y", "i2", True, _OF)}, {_axis_sql("i2", "x", "i3", True, _OF)},
o AS (SELECT preset, bound, w.v, least(greatest(floor(i3.f + dc + 0.5), 0), 255) AS u FROM i3 JOIN w USING (bz, by_, bx, z, y, x) JOIN m USING (bz, by_, bx) JOIN p USING (preset)),
e AS (SELECT preset, bound, v, abs(v - (u + CASE WHEN abs(v - u) > bound THEN sign(v - u) * (abs(v - u) - bound) ELSE 0 END)) AS e FROM o)
SELECT preset, count(*) FILTER (v > 0) AS voxels, CAST(sum(v) AS BIGINT) AS total, max(e) <= any_value(bound) AS within_bound, max(e) * 2 > any_value(bound) AS reaches_bound FROM p LEFT JOIN e USING (preset, bound) GROUP BY preset""")
def b1(spark, sf):
    """Encodes and decodes the volume at three presets: whether no voxel is off by more than the bound, and whether some is by more than half of it; the SQL does the same by itself."""
    volume = vox(spark, sf, 64)
    packed = B.pack_blocks(volume)
    out = None
    for level in (2, 4, 6):
        codec = B.Codec.preset(level)
        back = B.unpack_blocks(B.decode(B.encode(packed, codec), codec))
        pairs = volume.where("v > 0").join(back.withColumnRenamed("v", "r"), ["z", "y", "x"], "full")
        worst = pairs.agg(F.count("v").alias("voxels"), F.sum("v").cast("long").alias("total"), F.max(F.abs(F.coalesce("v", F.lit(0)) - F.coalesce("r", F.lit(0)))).alias("e"))
        worst = worst.select(F.lit(level).alias("preset"), "voxels", "total", (F.col("e") <= codec.max_error).alias("within_bound"), (F.col("e") * 2 > codec.max_error).alias("reaches_bound"))
        out = worst if out is None else out.unionByName(worst)
    return out


@query("b2_decode_metrics", f"""WITH vox AS (SELECT * FROM ({vox_sql(64)}) WHERE v > 0), b AS (SELECT DISTINCT z // {_N} AS bz, y // {_N} AS by_, x // {_N} AS bx FROM vox),
g AS (SELECT bz, by_, bx, a.i AS z, e.i AS y, h.i AS x FROM b, range({_N}) a(i), range({_N}) e(i), range({_N}) h(i)),
w AS (SELECT g.*, coalesce(v, 0) AS v FROM g LEFT JOIN vox ON vox.z = bz * {_N} + g.z AND vox.y = by_ * {_N} + g.y AND vox.x = bx * {_N} + g.x),
m AS (SELECT bz, by_, bx, floor(avg(v) + 0.5) AS dc FROM w GROUP BY 1, 2, 3), s AS (SELECT w.bz, w.by_, w.bx, w.z, w.y, w.x, v - dc AS f FROM w JOIN m USING (bz, by_, bx)), {_BASIS},
{_axis_sql("s", "z", "f1")}, {_axis_sql("f1", "y", "f2")}, {_axis_sql("f2", "x", "f3")},
l AS (SELECT *, 6.0e0 * pow(1.0e0 + z + y + x, 0.65) AS step FROM f3), q AS (SELECT *, sign(f) * floor(abs(f) / step + 0.2) AS level FROM l),
r AS (SELECT bz, by_, bx, z, y, x, CASE WHEN level = 0 THEN 0 ELSE sign(level) * step * (abs(level) + 0.2) END AS f FROM q),
{_axis_sql("r", "z", "i1", True)}, {_axis_sql("i1", "y", "i2", True)}, {_axis_sql("i2", "x", "i3", True)},
o AS (SELECT w.v, least(greatest(floor(i3.f + dc + 0.5), 0), 255) AS u FROM w JOIN i3 USING (bz, by_, bx, z, y, x) JOIN m USING (bz, by_, bx)),
t AS (SELECT avg((v - u) * (v - u)) AS mse, avg(v) AS a, avg(u) AS b, var_pop(v) AS va, var_pop(u) AS vb, covar_pop(v, u) AS c FROM o)
SELECT (SELECT count(*) FROM b) AS blocks, round(10 * log10(65025 / mse), 1) AS psnr, round((2 * a * b + 6.5025e0) * (2 * c + 58.5225e0) / ((a * a + b * b + 6.5025e0) * (va + vb + 58.5225e0)), 2) AS ssim FROM t""")
def b2(spark, sf):
    """PSNR and global SSIM of the decoded volume at quality 6 without a bound, in blocks of 4; the SQL transforms, quantises and decodes by itself."""
    volume = vox(spark, sf, 64)
    packed = materialize(B.pack_blocks(volume, _N), "packed")
    codec = B.Codec.of(6.0)
    back = B.decode(B.encode(packed, codec, _N), codec, _N)
    both = B.byte_pairs(packed.join(back.withColumnRenamed("data", "decoded"), ["bz", "by", "bx"]))
    return packed.agg(F.count(F.lit(1)).alias("blocks")).join(B.quality_metrics(both))


@query("b9_presets", "SELECT CAST(i AS INTEGER) AS level, [0.5e0, 0.5e0, 1.0e0, 2.5e0, 6.0e0, 16.0e0, 32.0e0, 64.0e0][i + 1] AS quality, CAST(1 << i AS INTEGER) AS max_error FROM range(8) t(i)")
def b9(spark, sf):
    rows = [(k, B.Codec.preset(k).quality, B.Codec.preset(k).max_error) for k in range(8)]
    return spark.createDataFrame(rows, "level int, quality double, max_error int")


@query("b11_train_priors", f"WITH {DCT}, l AS (SELECT z, y, x, {LEVEL} AS level FROM dct) SELECT CAST(least(trunc((z + y + x) * 8 / 10.0e0), 7) AS INTEGER) AS band, CAST(least(greatest(floor(avg(CASE WHEN level = 0 THEN 1.0e0 ELSE 0.0e0 END) * 4096 + 0.5), 32), 4064) AS INTEGER) AS p FROM l GROUP BY 1")
def b11(spark, sf):
    return B.train_priors(b4(spark, sf), 8, 9)


@query("b7_scan_order", "WITH c AS (SELECT CAST(i AS INTEGER) AS index, CAST(i // 256 + i // 16 % 16 + i % 16 AS INTEGER) AS l1 FROM range(4096) t(i)) SELECT index, l1, CAST(row_number() OVER (ORDER BY l1, index) - 1 AS INTEGER) AS rank FROM c")
def b7(spark, sf):
    return B.scan_order(spark, 16)


@query("b12_fraction_map", f"""WITH vox AS ({vox_sql(64)}), b AS (SELECT z // 4 AS bz, y // 4 AS by_, x // 4 AS bx, count(*) FILTER (v > 0) AS m FROM vox GROUP BY 1, 2, 3)
SELECT CAST(bz // 4 AS INTEGER) AS cz, CAST(by_ // 4 AS INTEGER) AS cy, CAST(bx // 4 AS INTEGER) AS cx, CAST(sum(CASE WHEN m = 0 THEN 0 ELSE greatest((m * 15 + 32) // 64, 1) END) AS BIGINT) AS nibble_sum, count(*) FILTER (m > 0) AS n_present FROM b GROUP BY 1, 2, 3""")
def b12(spark, sf):
    """The nibbles of a chunk's blocks, stored as a plain map and summed."""
    b = V.block_stats(vox(spark, sf, 64), 4)
    c = b.select(*(F.expr(f"b{a} DIV 4").cast("int").alias(f"c{a}") for a in "zyx"), "nibble", "present")
    return c.groupBy("cz", "cy", "cx").agg(F.sum("nibble").cast("long").alias("nibble_sum"), F.count_if("present").alias("n_present"))


def _deblock_sql(quality=4.0, edge=8, d=16):
    beta, most = int(3 * quality + 6), int(0.5 * quality + 1)
    parts, last = [], "dense"
    for axis in ("x", "y", "z"):
        part = ", ".join(a for a in ("z", "y", "x") if a != axis)
        w = f"OVER (PARTITION BY {part} ORDER BY {axis})"
        parts.append(f"""s{axis} AS (SELECT z, y, x, v, lag(v, 1) {w} AS a1, lag(v, 2) {w} AS a2, lead(v, 1) {w} AS b1, lead(v, 2) {w} AS b2 FROM {last}),
e{axis} AS (SELECT *, CASE WHEN {axis} % {edge} = {edge - 1} AND b1 IS NOT NULL THEN 1 WHEN {axis} % {edge} = 0 AND {axis} > 0 THEN 2 ELSE 0 END AS side FROM s{axis}),
p{axis} AS (SELECT *, CASE side WHEN 1 THEN v ELSE a1 END AS p0, CASE side WHEN 1 THEN b1 ELSE v END AS q0, CASE side WHEN 1 THEN a1 ELSE a2 END AS p1, CASE side WHEN 1 THEN b2 ELSE b1 END AS q1 FROM e{axis}),
d{axis} AS (SELECT *, greatest(least((4 * (q0 - p0) + (CASE WHEN coalesce(p1, 0) > 0 THEN p1 ELSE p0 END - CASE WHEN coalesce(q1, 0) > 0 THEN q1 ELSE q0 END) + 4) >> 3, {most}), -{most}) AS delta FROM p{axis}),
o{axis} AS (SELECT z, y, x, CASE WHEN side = 0 OR p0 = 0 OR q0 = 0 OR abs(q0 - p0) >= {beta} THEN v WHEN side = 1 THEN greatest(least(p0 + delta, 255), 1) ELSE greatest(least(q0 - delta, 255), 1) END AS v FROM d{axis})""")
        last = f"o{axis}"
    return f"WITH vox AS ({vox_sql(d)}), g AS ({grid_sql(d, d, d)}), dense AS (SELECT z, y, x, coalesce(v, 0) AS v FROM g LEFT JOIN vox USING (z, y, x)), {', '.join(parts)} SELECT z, y, x, CAST(v AS INTEGER) AS v FROM {last}"


@query("b13_deblock", _deblock_sql())
def b13(spark, sf):
    return B.deblock(P.densify(vox(spark, sf, 16), (16, 16, 16)), 4.0, 8)


@query("b14_chunk_hash", f"WITH vox AS ({vox_sql(64)}) SELECT count(DISTINCT (z // 16, y // 16, x // 16)) AS n_chunks, count(DISTINCT (z // 16, y // 16, x // 16)) AS n_hashes FROM vox")
def b14(spark, sf):
    """Chunk hashes: one per chunk, all different."""
    return V.voxel_hash(vox(spark, sf, 64), 16).agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("hash").alias("n_hashes"))


@query("b15_pack_blocks", f"WITH vox AS ({vox_sql(64)}) SELECT CAST(z // 16 AS INTEGER) AS bz, CAST(y // 16 AS INTEGER) AS by, CAST(x // 16 AS INTEGER) AS bx, 4096 AS n_bytes, count(*) FILTER (v > 0) AS n_material, CAST(sum(v) AS BIGINT) AS total FROM vox WHERE v > 0 GROUP BY 1, 2, 3")
def b15(spark, sf):
    """Blocks packed to bytes and unpacked: sizes, material and sums survive."""
    packed = B.pack_blocks(vox(spark, sf, 64))
    sizes = packed.select("bz", "by", "bx", F.octet_length("data").cast("int").alias("n_bytes"))
    back = V.with_cells(B.unpack_blocks(packed), "b", 16).groupBy("bz", "by", "bx").agg(F.count(F.lit(1)).alias("n_material"), F.sum("v").cast("long").alias("total"))
    return sizes.join(back, ["bz", "by", "bx"])

"""Queries of lookups, range reads and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import volume as V
from ..sources.volumes import grid_sql, read_table, vox, vox_sql
from .register import query

VOX32, VOX64 = f"WITH vox AS ({vox_sql(32)})", f"WITH vox AS ({vox_sql(64)})"
EDGE, CHUNK_EDGE = 4, 16


@query("g1_lod_decimate", f"""{VOX32}
SELECT CAST(z // 2 AS INTEGER) AS z, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x,
       CAST((CAST(sum(v) AS BIGINT) + count(*) // 2) // count(*) AS INTEGER) AS v
FROM vox WHERE v > 0 GROUP BY 1, 2, 3""")
def g1(spark, sf):
    return A.decimate(vox(spark, sf))


def _pyramid_sql():
    parts, last = [], "vox"
    for k in range(1, 4):
        parts.append(f"""l{k} AS (SELECT CAST(z // 2 AS INTEGER) AS z, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x,
          CAST((CAST(sum(v) AS BIGINT) + count(*) // 2) // count(*) AS INTEGER) AS v FROM {last} WHERE v > 0 GROUP BY 1, 2, 3)""")
        last = f"l{k}"
    return f"""{VOX64}, {", ".join(parts)}
SELECT CAST(0 AS INTEGER) AS lod, z, y, x, v FROM vox WHERE v > 0
{" ".join(f"UNION ALL SELECT CAST({k} AS INTEGER), z, y, x, v FROM l{k}" for k in range(1, 4))}"""


@query("g2_lod_pyramid", _pyramid_sql())
def g2(spark, sf):
    return A.pyramid(vox(spark, sf, 64), 64, 8)


@query("g3_material_nibble", f"""{VOX32}
SELECT CAST(z // 4 AS INTEGER) AS bz, CAST(y // 4 AS INTEGER) AS by, CAST(x // 4 AS INTEGER) AS bx, count(*) FILTER (v > 0) AS material,
  CAST(CASE WHEN count(*) FILTER (v > 0) = 0 THEN 0 ELSE greatest((count(*) FILTER (v > 0) * 15 + 32) // 64, 1) END AS INTEGER) AS nibble
FROM vox GROUP BY 1, 2, 3""")
def g3(spark, sf):
    return V.block_stats(vox(spark, sf), EDGE).select("bz", "by", "bx", "material", "nibble")


@query("g4_occupancy", f"""{VOX64}, b AS (SELECT DISTINCT z // 4 AS bz, y // 4 AS by_, x // 4 AS bx FROM vox WHERE v > 0)
SELECT CAST(bz // 4 AS INTEGER) AS cz, CAST(by_ // 4 AS INTEGER) AS cy, CAST(bx // 4 AS INTEGER) AS cx,
  CAST((bz % 4) * 16 + (by_ % 4) * 4 + bx % 4 AS INTEGER) AS block_index,
  CAST(row_number() OVER (PARTITION BY bz // 4, by_ // 4, bx // 4 ORDER BY (bz % 4) * 16 + (by_ % 4) * 4 + bx % 4) - 1 AS INTEGER) AS rank FROM b""")
def g4(spark, sf):
    return A.occupancy(vox(spark, sf, 64), CHUNK_EDGE, EDGE)


@query("g4_chunk_popcount", f"""{VOX64}, b AS (SELECT DISTINCT z // 4 AS bz, y // 4 AS by_, x // 4 AS bx FROM vox WHERE v > 0)
SELECT CAST(bz // 4 AS INTEGER) AS cz, CAST(by_ // 4 AS INTEGER) AS cy, CAST(bx // 4 AS INTEGER) AS cx, count(*) AS popcount FROM b GROUP BY 1, 2, 3""")
def g4b(spark, sf):
    return A.occupancy(vox(spark, sf, 64), CHUNK_EDGE, EDGE).groupBy("cz", "cy", "cx").agg(F.count(F.lit(1)).alias("popcount"))


@query("g5_block_offsets", f"""{VOX64}, b AS (SELECT z // 4 AS bz, y // 4 AS by_, x // 4 AS bx, count(*) AS len FROM vox WHERE v > 0 GROUP BY 1, 2, 3),
k AS (SELECT CAST(bz // 4 AS INTEGER) AS cz, CAST(by_ // 4 AS INTEGER) AS cy, CAST(bx // 4 AS INTEGER) AS cx, CAST((bz % 4) * 16 + (by_ % 4) * 4 + bx % 4 AS INTEGER) AS block_index, len FROM b)
SELECT *, CAST(sum(len) OVER (PARTITION BY cz, cy, cx ORDER BY block_index ROWS UNBOUNDED PRECEDING) - len AS BIGINT) AS "offset" FROM k""")
def g5(spark, sf):
    per = CHUNK_EDGE // EDGE
    b = V.with_cells(vox(spark, sf, 64).where("v > 0"), "b", EDGE).groupBy("bz", "by", "bx").agg(F.count(F.lit(1)).alias("len"))
    k = b.select(*(F.expr(f"b{a} DIV {per}").cast("int").alias(f"c{a}") for a in "zyx"), ((F.col("bz") % per) * per * per + (F.col("by") % per) * per + F.col("bx") % per).cast("int").alias("block_index"), "len")
    return A.prefix_offsets(k, ["cz", "cy", "cx"], "block_index", "len")


QUANTISED = "CASE WHEN coalesce(v, 0) = 0 THEN 0 ELSE least(255, ((v + 4) // 8) * 8) END"


@query("g6_error_metrics", f"""{VOX32}, e AS (SELECT abs(v - CAST({QUANTISED} AS INTEGER)) AS e, v > 0 OR {QUANTISED} > 0 AS m FROM vox),
h AS (SELECT e, count(*) AS n, count(*) FILTER (m) AS nm FROM e GROUP BY e),
r AS (SELECT *, sum(n) OVER (ORDER BY e) AS cum, sum(n) OVER () AS total FROM h),
a AS (SELECT CAST(sum(e * e * n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS mse, CAST(sum(e * nm) AS DOUBLE) / CAST(sum(nm) AS DOUBLE) AS mae, CAST(max(e) FILTER (nm > 0) AS INTEGER) AS max_error,
  {", ".join(f"CAST(min(e) FILTER (cum >= floor({p / 100} * total)) AS INTEGER) AS p{p}" for p in (50, 90, 95, 99))} FROM r)
SELECT round(mse, 4) AS mse, round(mae, 4) AS mae, max_error, p50, p90, p95, p99, round(10 * log10(65025.0 / greatest(mse, 1e-12)), 4) AS psnr FROM a""")
def g6(spark, sf):
    b = F.expr("CASE WHEN v = 0 THEN 0 ELSE least(255, ((v + 4) DIV 8) * 8) END").cast("int")
    out = A.error_metrics(vox(spark, sf).select(F.col("v").alias("a"), b.alias("b")))
    return out.select(*(F.round(c, 4).alias(c) for c in ("mse", "mae")), "max_error", "p50", "p90", "p95", "p99", F.round("psnr", 4).alias("psnr"))


@query("g7_ssim", f"""{VOX32}, g AS ({grid_sql(32, 32, 32)}),
d AS (SELECT g.z, g.y, g.x, coalesce(v, 0) AS a, coalesce(CAST({QUANTISED} AS INTEGER), 0) AS b FROM g LEFT JOIN vox USING (z, y, x)),
s AS (SELECT sum(a) / 512.0e0 AS ma, sum(b) / 512.0e0 AS mb, sum(a * a) / 512.0e0 AS aa, sum(b * b) / 512.0e0 AS bb, sum(a * b) / 512.0e0 AS ab FROM d GROUP BY z // 8, y // 8, x // 8)
SELECT round(avg((2 * ma * mb + 6.5025e0) * (2 * (ab - ma * mb) + 58.5225e0) / ((ma * ma + mb * mb + 6.5025e0) * (aa - ma * ma + bb - mb * mb + 58.5225e0))), 4) AS ssim FROM s""")
def g7(spark, sf):
    b = F.expr("CASE WHEN v = 0 THEN 0 ELSE least(255, ((v + 4) DIV 8) * 8) END")
    dense = V.region(vox(spark, sf), 0, 0, 0, 32, 32, 32)
    return A.ssim(dense.select("z", "y", "x", F.col("v").alias("a"), b.alias("b"))).select(F.round("ssim", 4).alias("ssim"))


@query("g8_histogram", f"{VOX32} SELECT v AS bin, count(*) AS n FROM vox GROUP BY v")
def g8(spark, sf):
    return A.histogram(vox(spark, sf), F.col("v"))


SURFACE = """grid AS (SELECT CAST(p_partkey // 40 AS INTEGER) AS gy, CAST(p_partkey % 40 AS INTEGER) AS gx,
  CASE WHEN p_size % 17 <> 0 THEN p_partkey % 97 / 4.0 END AS pz, CASE WHEN p_size % 17 <> 0 THEN (p_partkey // 40) * 2.0 END AS py,
  CASE WHEN p_size % 17 <> 0 THEN (p_partkey % 40) * 1.5 END AS px, 5 + p_size / 10.0 AS depth FROM part),
dim AS (SELECT CAST(coalesce(max(p_partkey), 0) // 40 + 1 AS INTEGER) AS h FROM part)"""


def surface(spark, sf):
    """A surface grid (gy, gx, pz, py, px, depth) from the part table; some points are invalid."""
    ok = F.col("p_size") % 17 != 0
    k = F.col("p_partkey")
    row = F.expr("p_partkey DIV 40")
    return read_table(spark, sf, "part").select(
        row.cast("int").alias("gy"), (k % 40).cast("int").alias("gx"), F.when(ok, k % 97 / 4.0).alias("pz"), F.when(ok, row * 2.0).alias("py"), F.when(ok, (k % 40) * 1.5).alias("px"), (5 + F.col("p_size") / 10.0).alias("depth"))


def surface_height(spark, sf) -> int:
    """Rows of the surface grid, by the greatest key."""
    return (read_table(spark, sf, "part").agg(F.max("p_partkey")).first()[0] or 0) // 40 + 1


@query("g11_surface_stats", f"WITH {SURFACE} SELECT round(CAST(avg(depth) FILTER (pz IS NOT NULL) AS DOUBLE), 4) AS mean_depth, count(*) FILTER (pz IS NOT NULL) AS n_valid, count(*) FILTER (pz IS NULL) AS n_invalid FROM grid")
def g11(spark, sf):
    return A.surface_stats(surface(spark, sf)).withColumn("mean_depth", F.round("mean_depth", 4))


@query("g12_quad_spacing", f"""WITH {SURFACE}, t AS (SELECT CAST(i * (h - 1) // greatest(least(h, 32) - 1, 1) AS INTEGER) AS gy, CAST(i * 38 // greatest(least(h, 32) - 1, 1) AS INTEGER) AS gx FROM dim, range(32) r(i) WHERE i < least(h, 32))
SELECT round(CAST(coalesce(avg(sqrt((b.pz - a.pz) ** 2 + (b.py - a.py) ** 2 + (b.px - a.px) ** 2)), 1.0) AS DOUBLE), 4) AS spacing
FROM t JOIN grid a USING (gy, gx) JOIN grid b ON b.gy = t.gy AND b.gx = t.gx + 1""")
def g12(spark, sf):
    return A.quad_spacing(surface(spark, sf), 40, surface_height(spark, sf)).select(F.round("spacing", 4).alias("spacing"))


@query("g13_covariance", f"""WITH {SURFACE}, p AS (SELECT px AS x, py AS y, pz AS z FROM grid WHERE pz IS NOT NULL), m AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p)
SELECT round(CAST(first(mx) AS DOUBLE), 4) AS mx, round(CAST(first(my) AS DOUBLE), 4) AS my, round(CAST(first(mz) AS DOUBLE), 4) AS mz,
  {", ".join(f"round(CAST(sum(({a} - m{a}) * ({b} - m{b})) AS DOUBLE), 2) AS s{a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))},
  {", ".join(f"CAST(min({a}) AS DOUBLE) AS min_{a}, CAST(max({a}) AS DOUBLE) AS max_{a}" for a in "xyz")} FROM p, m""")
def g13(spark, sf):
    out = A.covariance(surface(spark, sf).where("pz IS NOT NULL").select(F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z")))
    rounded = {"m": 4, "s": 2}
    return out.select(*(F.round(c, rounded[c[0]]).alias(c) if c[:3] not in ("min", "max") else F.col(c) for c in out.columns))


@query("g16_latency_percentiles", """WITH c AS (SELECT CAST(floor(value * 10) AS BIGINT) AS lat FROM events), s AS (SELECT list(lat ORDER BY lat) AS l, count(*) AS n FROM c WHERE lat IS NOT NULL)
SELECT l[1 + CAST(floor(50 * (n - 1) / 100) AS BIGINT)] AS p50, l[1 + CAST(floor(90 * (n - 1) / 100) AS BIGINT)] AS p90, l[1 + CAST(floor(99 * (n - 1) / 100) AS BIGINT)] AS p99 FROM s""")
def g16(spark, sf):
    lat = read_table(spark, sf, "events").select(F.floor(F.col("value") * 10).cast("long").alias("lat")).where("lat IS NOT NULL")
    return A.rank_percentile(lat, "lat")


# ---------------------------------------------------------------- lookups and reads


@query("c1_resolve_chunks", f"""{VOX64}, c AS (SELECT z // 16 AS cz, y // 16 AS cy, x // 16 AS cx, CASE WHEN max(v) > 0 THEN 1 ELSE 2 END AS state FROM vox GROUP BY 1, 2, 3),
w AS (SELECT CAST(i % 6 AS INTEGER) AS cz, CAST(i % 5 AS INTEGER) AS cy, CAST(i % 7 - 1 AS INTEGER) AS cx FROM range(40) t(i))
SELECT w.cz, w.cy, w.cx, CAST(coalesce(state, 0) AS INTEGER) AS state FROM w LEFT JOIN c USING (cz, cy, cx)""")
def c1(spark, sf):
    i = F.col("id")
    wanted = spark.range(40).select((i % 6).cast("int").alias("cz"), (i % 5).cast("int").alias("cy"), (i % 7 - 1).cast("int").alias("cx"))
    return V.resolve_chunks(wanted, V.chunk_table(vox(spark, sf, 64), CHUNK_EDGE))


@query("c3_coverage", f"""{VOX64}, c AS (SELECT z // 4 AS cz, y // 4 AS cy, x // 4 AS cx, CASE WHEN max(v) > 0 THEN 1 ELSE 2 END AS state FROM vox GROUP BY 1, 2, 3),
g AS ({grid_sql(16, 16, 16)})
SELECT g.z AS cz, g.y AS cy, g.x AS cx, CAST(coalesce(state, 0) AS INTEGER) AS state FROM g LEFT JOIN c ON c.cz = g.z AND c.cy = g.y AND c.cx = g.x""")
def c3(spark, sf):
    return V.coverage(V.chunk_table(vox(spark, sf, 64), EDGE), 16, 16, 16)


def _region_sql(z0, y0, x0, dz, dy, dx, dim=32):
    return f"""WITH vox AS ({vox_sql(dim)}), g AS ({grid_sql(dz, dy, dx)})
SELECT CAST(g.z + {z0} AS INTEGER) AS z, CAST(g.y + {y0} AS INTEGER) AS y, CAST(g.x + {x0} AS INTEGER) AS x, coalesce(v, 0) AS v
FROM g LEFT JOIN vox ON vox.z = g.z + {z0} AND vox.y = g.y + {y0} AND vox.x = g.x + {x0}"""


def store_of(spark, sf):
    """The volume in a store of chunks of 32, at a quality at which it comes back exactly."""
    from .store_queries import _archive

    return _archive(spark, sf)


@query("c4_block_decode", _region_sql(16, 0, 16, 16, 16, 16, 64))
def c4(spark, sf):
    """A block out of a store: its payload alone is read and decoded."""
    return V.region(store_of(spark, sf).region(16, 0, 16, 16, 16, 16), 16, 0, 16, 16, 16, 16)


@query("c6_chunk_decode", _region_sql(32, 32, 0, 32, 32, 32, 64))
def c6(spark, sf):
    """A chunk out of a store."""
    return V.region(store_of(spark, sf).region(32, 32, 0, 32, 32, 32), 32, 32, 0, 32, 32, 32)


@query("c7_region_read", _region_sql(5, -3, 20, 11, 13, 17))
def c7(spark, sf):
    return V.region(vox(spark, sf), 5, -3, 20, 11, 13, 17)


@query("c8_batched_crops", f"""{VOX64}, b AS (SELECT o_orderkey AS box_id, CAST(o_orderkey * 7 % 56 AS INTEGER) AS z0, CAST(o_custkey * 5 % 56 AS INTEGER) AS y0, CAST(o_orderkey * 3 % 56 AS INTEGER) AS x0 FROM orders)
SELECT box_id, CAST(z - z0 AS INTEGER) AS z, CAST(y - y0 AS INTEGER) AS y, CAST(x - x0 AS INTEGER) AS x, v FROM (SELECT *, unnest(range(8)) AS dz FROM b) JOIN vox ON z = z0 + dz AND y BETWEEN y0 AND y0 + 7 AND x BETWEEN x0 AND x0 + 7 WHERE v > 0""")
def c8(spark, sf):
    k = F.col("o_orderkey")
    boxes = read_table(spark, sf, "orders").select(k.alias("box_id"), (k * 7 % 56).cast("int").alias("z0"), (F.col("o_custkey") * 5 % 56).cast("int").alias("y0"), (k * 3 % 56).cast("int").alias("x0"))
    return V.regions(vox(spark, sf, 64), boxes, 8, 8, 8, 8)


@query("c9_block_present", f"{VOX64} SELECT CAST(z // 4 AS INTEGER) AS bz, CAST(y // 4 AS INTEGER) AS by, CAST(x // 4 AS INTEGER) AS bx, max(v) > 0 AS present FROM vox GROUP BY 1, 2, 3")
def c9(spark, sf):
    return V.block_stats(vox(spark, sf, 64), EDGE).select("bz", "by", "bx", "present")


@query("c10_block_fraction", f"""{VOX64} SELECT CAST(z // 4 AS INTEGER) AS bz, CAST(y // 4 AS INTEGER) AS by, CAST(x // 4 AS INTEGER) AS bx,
  round(CASE WHEN count(*) FILTER (v > 0) = 0 THEN 0 ELSE greatest((count(*) FILTER (v > 0) * 15 + 32) // 64, 1) END / 15.0e0, 4) AS fraction FROM vox GROUP BY 1, 2, 3""")
def c10(spark, sf):
    return V.block_stats(vox(spark, sf, 64), EDGE).select("bz", "by", "bx", F.round("fraction", 4).alias("fraction"))


BOXES = V.candidate_boxes(42, 8, (64, 64, 64), (16, 16, 16), 256)


@query("c11_sample_boxes", f"""{VOX64}, b AS (SELECT * FROM (VALUES {", ".join(map(str, BOXES))}) t(attempt, z0, y0, x0)),
f AS (SELECT z // 4 AS bz, y // 4 AS by_, x // 4 AS bx, CASE WHEN count(*) FILTER (v > 0) = 0 THEN 0 ELSE greatest((count(*) FILTER (v > 0) * 15 + 32) // 64, 1) END / 15.0e0 AS fraction FROM vox GROUP BY 1, 2, 3),
t AS (SELECT attempt, z0, y0, x0, unnest(range(z0 // 4, (z0 + 15) // 4 + 1)) AS bz FROM b), u AS (SELECT *, unnest(range(y0 // 4, (y0 + 15) // 4 + 1)) AS by_ FROM t), w AS (SELECT *, unnest(range(x0 // 4, (x0 + 15) // 4 + 1)) AS bx FROM u),
m AS (SELECT attempt, z0, y0, x0, avg(coalesce(fraction, 0)) AS mean_fraction FROM w LEFT JOIN f USING (bz, by_, bx) GROUP BY ALL HAVING avg(coalesce(fraction, 0)) >= 0.1)
SELECT CAST(attempt AS INTEGER) AS attempt, CAST(z0 AS INTEGER) AS z0, CAST(y0 AS INTEGER) AS y0, CAST(x0 AS INTEGER) AS x0, round(mean_fraction, 4) AS mean_fraction FROM m ORDER BY attempt LIMIT 8""")
def c11(spark, sf):
    return V.sample_boxes(vox(spark, sf, 64), BOXES, 8, (16, 16, 16), EDGE, 0.1).withColumn("mean_fraction", F.round("mean_fraction", 4))


@query("c16_introspection", f"""{VOX64} SELECT CAST(max(z) + 1 AS INTEGER) AS nz, CAST(max(y) + 1 AS INTEGER) AS ny, CAST(max(x) + 1 AS INTEGER) AS nx,
  count(*) AS n_cells, count(*) FILTER (v > 0) AS n_material, count(DISTINCT (z // 16, y // 16, x // 16)) AS n_chunks FROM vox""")
def c16(spark, sf):
    chunks = V.chunk_table(vox(spark, sf, 64), CHUNK_EDGE)
    dims = V.with_cells(vox(spark, sf, 64), "c", CHUNK_EDGE).groupBy("cz", "cy", "cx").agg(*(F.max(a).alias(a) for a in "zyx"))
    joined = dims.join(chunks, ["cz", "cy", "cx"])
    return joined.agg(*((F.max(a) + 1).cast("int").alias(f"n{a}") for a in "zyx"), F.sum("n_cells").alias("n_cells"), F.sum("n_material").alias("n_material"), F.count(F.lit(1)).alias("n_chunks"))


@query("c15_integrity_scan", f"{VOX64} SELECT count(DISTINCT (z // 16, y // 16, x // 16)) AS n_corrupt FROM vox WHERE v = 251")
def c15(spark, sf):
    """Counts chunks that a changed voxel value (251 to 250) leaves with another hash than stored."""
    volume = vox(spark, sf, 64)
    stored = V.voxel_hash(volume, CHUNK_EDGE)
    changed = volume.withColumn("v", F.when(F.col("v") == 251, 250).otherwise(F.col("v")))
    return V.corrupt_chunks(changed, stored, CHUNK_EDGE).agg(F.count(F.lit(1)).alias("n_corrupt"))


@query("c2_absent_or_empty", f"""{VOX64}, c AS (SELECT z // 4 AS cz, y // 4 AS cy, x // 4 AS cx, CASE WHEN max(v) > 0 THEN 1 ELSE 2 END AS state FROM vox GROUP BY 1, 2, 3), g AS ({grid_sql(16, 16, 16)})
SELECT CAST(coalesce(state, 0) AS INTEGER) AS state, count(*) AS n FROM g LEFT JOIN c ON c.cz = g.z AND c.cy = g.y AND c.cx = g.x GROUP BY 1""")
def c2(spark, sf):
    return c3(spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("c14_structure", f"""{VOX64}, b AS (SELECT DISTINCT z // 16 AS bz, y // 16 AS by_, x // 16 AS bx FROM vox WHERE v > 0)
SELECT CAST(CASE WHEN by_ = 2 THEN -1 ELSE bz END AS INTEGER) AS bz, CAST(by_ AS INTEGER) AS by, CAST(bx AS INTEGER) AS bx, CAST(CASE WHEN bx = 1 THEN 4000 ELSE 4096 END AS INTEGER) AS n_bytes FROM b WHERE by_ = 2 OR bx = 1""")
def c14(spark, sf):
    """Packed blocks that can't be right: some are cut short, some have a number below 0."""
    from ..operators.codec import pack_blocks

    blocks = pack_blocks(vox(spark, sf, 64))
    wrong = blocks.withColumns({"bz": F.when(F.col("by") == 2, -1).otherwise(F.col("bz")), "data": F.when(F.col("bx") == 1, F.expr("substring(data, 1, 4000)")).otherwise(F.col("data"))})
    return V.structure_ok(wrong, 16).select("bz", "by", "bx", F.octet_length("data").alias("n_bytes"))

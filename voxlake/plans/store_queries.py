"""Queries that write a store or file into the shared folder and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.coords import AXES
from ..functions.scratch import materialize, scratch_path
from ..sources.store import CHUNK_KEYS, Archive, Geometry
from ..operators import volume as V
from ..sources.volumes import grid_sql, read_table, vox, vox_sql
from .register import query

VOX64 = f"WITH vox AS ({vox_sql(64)})"
LOSSLESS = 0.01


def _archive(spark, sf, nlods=1):
    out = Archive.create(spark, scratch_path(spark, "archive"), Geometry(64, 64, 64, 16, 32, LOSSLESS, 0, nlods), "volume from order lines")
    out.build(vox(spark, sf, 64), exact=True)  # a fine quality alone rounds a lone voxel among equal ones to its neighbours' side
    return Archive.open(spark, out.path, (64, 64, 64))


@query("a17_build_and_read", f"""{VOX64}, l1 AS (SELECT CAST(z // 2 AS INTEGER) AS z, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, CAST((CAST(sum(v) AS BIGINT) + count(*) // 2) // count(*) AS INTEGER) AS v FROM vox WHERE v > 0 GROUP BY 1, 2, 3)
SELECT CAST(0 AS INTEGER) AS lod, z, y, x, v FROM vox WHERE v > 0 AND z BETWEEN 10 AND 40 AND y BETWEEN 3 AND 22 AND x BETWEEN 0 AND 63 UNION ALL SELECT 1, z, y, x, v FROM l1 WHERE z BETWEEN 10 AND 40 AND y BETWEEN 3 AND 22 AND x BETWEEN 0 AND 63""")
def a17(spark, sf):
    """Builds a store of two levels and reads a box of each; with residuals the voxels come back exactly."""
    store = _archive(spark, sf, 2)
    return store.region(10, 3, 0, 31, 20, 64).select(F.lit(0).alias("lod"), "*").unionByName(store.region(10, 3, 0, 31, 20, 64, 1).select(F.lit(1).alias("lod"), "*"))


@query("a20_append_last_wins", f"{VOX64} SELECT z, y, x, v FROM vox WHERE v > 0 AND NOT (z < 32 AND y < 32 AND x < 32) UNION ALL SELECT z, y, x, 7 FROM vox WHERE v > 0 AND z < 32 AND y < 32 AND x < 32")
def a20(spark, sf):
    """A chunk that is appended again replaces its earlier version."""
    store = _archive(spark, sf)
    first = vox(spark, sf, 64).where("v > 0 AND z < 32 AND y < 32 AND x < 32")
    store.append(first.withColumn("v", F.lit(7)), exact=True)
    return store.region(0, 0, 0, 64, 64, 64)


@query("a26_verbatim_copy", f"{VOX64} SELECT z, y, x, v FROM vox WHERE v > 0 AND z < 32")
def a26(spark, sf):
    """Payloads of a box of chunks are copied without recoding."""
    store = _archive(spark, sf)
    other = Archive.create(spark, scratch_path(spark, "copy"), store.geometry)
    other.copy_from(store, (0, 0, 0, 1, 2, 2))
    return other.region(0, 0, 0, 64, 64, 64)


@query("a24_metadata", "SELECT 'volume of ' || count(*) || ' lines' AS metadata, CAST(64 AS INTEGER) AS nz, CAST(0 AS INTEGER) AS codec FROM lineitem")
def a24(spark, sf):
    """Text that is stored anew with the store, its dims and its block codec, read back from the files."""
    store = Archive.create(spark, scratch_path(spark, "meta"), Geometry(64, 64, 64), "first")
    store.set_metadata(f"volume of {read_table(spark, sf, 'lineitem').count()} lines")
    again = Archive.open(spark, store.path)
    return spark.range(1).select(F.lit(again.metadata).alias("metadata"), F.lit(again.geometry.nz).alias("nz"), F.lit(again.geometry.codec).alias("codec"))


@query("a7_all_air", f"""{VOX64}, c AS (SELECT z // 32 AS cz, y // 32 AS cy, x // 32 AS cx, max(v) AS top FROM vox WHERE z < 32 OR y < 32 GROUP BY 1, 2, 3), g AS ({grid_sql(2, 2, 2)})
SELECT g.z AS cz, g.y AS cy, g.x AS cx, CAST(CASE WHEN top IS NULL THEN -1 WHEN top > 0 THEN 0 ELSE 1 END AS INTEGER) AS air FROM g LEFT JOIN c ON c.cz = g.z AND c.cy = g.y AND c.cx = g.x""")
def a7(spark, sf):
    """Which chunks are all air, known from the chunk table alone."""
    store = Archive.create(spark, scratch_path(spark, "air"), Geometry(64, 64, 64, 16, 32, LOSSLESS))
    store.append(vox(spark, sf, 64).where("z < 32 OR y < 32"))
    return store.all_air()


@query("a22_append_target", f"{VOX64} SELECT true AS within, count(DISTINCT (z // 16, y // 16, x // 16)) AS n_blocks FROM vox WHERE v > 0")
def a22(spark, sf):
    """A quality chosen for a ratio lies within its limits, is stored with the blocks, and they decode."""
    store = Archive.create(spark, scratch_path(spark, "target"), Geometry(64, 64, 64, 16, 32))
    q = store.append_target(vox(spark, sf, 64), 12.0)
    return store.blocks().agg((F.min("quality").eqNullSafe(F.max("quality")) & (F.abs(F.min("quality") - q) < 1e-9) & F.min("quality").between(0.5, 24.0)).alias("within"), F.count(F.lit(1)).alias("n_blocks"))


@query("a33_box_fetch", f"""{VOX64}, g AS ({grid_sql(20, 30, 17)}) SELECT CAST(g.z + 7 AS INTEGER) AS z, CAST(g.y + 20 AS INTEGER) AS y, CAST(g.x + 50 AS INTEGER) AS x, CAST(coalesce(v, 0) AS INTEGER) AS v
FROM g LEFT JOIN vox ON vox.z = g.z + 7 AND vox.y = g.y + 20 AND vox.x = g.x + 50""")
def a33(spark, sf):
    """A dense box out of a store, air and what lies outside as 0."""
    return V.region(_archive(spark, sf).region(7, 20, 50, 20, 30, 17), 7, 20, 50, 20, 30, 17)


@query("b10_priors_store", f"SELECT CAST(p_size AS INTEGER) AS band, CAST(CASE WHEN p_size <= 3 THEN 2048 ELSE least(greatest(count(*) * 7, 32), 4064) END AS INTEGER) AS p FROM part GROUP BY p_size")
def b10(spark, sf):
    """Priors stored with a store; those of some bands are stored again, and count."""
    store = Archive.create(spark, scratch_path(spark, "priors"), Geometry(64, 64, 64))
    counts = read_table(spark, sf, "part").groupBy(F.col("p_size").cast("int").alias("band")).agg(F.least(F.greatest(F.count(F.lit(1)) * 7, F.lit(32)), F.lit(4064)).cast("int").alias("p"))
    store.set_priors(counts)
    store.set_priors(counts.where("band <= 3").withColumn("p", F.lit(2048)))
    return store.priors()


@query("b12_stored_fractions", f"""{VOX64} SELECT CAST(z // 16 AS INTEGER) AS bz, CAST(y // 16 AS INTEGER) AS by, CAST(x // 16 AS INTEGER) AS bx, round(greatest((count(*) FILTER (v > 0) * 15 + 2048) // 4096, 1) / 15.0e0, 6) AS fraction
FROM vox GROUP BY 1, 2, 3 HAVING count(*) FILTER (v > 0) > 0""")
def b12(spark, sf):
    """The fraction map that was written with each chunk, read back without its blocks."""
    return _archive(spark, sf).fractions().withColumn("fraction", F.round("fraction", 6))


@query("a27_export_order", f"""{VOX64}, b AS (SELECT DISTINCT CAST(z // 16 AS INTEGER) AS bz, CAST(y // 16 AS INTEGER) AS by_, CAST(x // 16 AS INTEGER) AS bx FROM vox WHERE v > 0)
SELECT bz, by_ AS by, bx, CAST(row_number() OVER (ORDER BY (bz // 2) * 4 + (by_ // 2) * 2 + bx // 2, bz, by_, bx) - 1 AS INTEGER) AS position FROM b""")
def a27(spark, sf):
    return _archive(spark, sf).export_order().select("bz", "by", "bx", F.col("position").cast("int").alias("position"))


def damaged(spark, sf):
    """A copy of the store in which, by rule, payloads are cut short, blocks are gone, and qualities are other than written."""
    store = _archive(spark, sf)
    other = Archive.create(spark, scratch_path(spark, "damaged"), store.geometry)
    other.copy_from(store)
    rule = (F.col("bz") * 7 + F.col("by") * 3 + F.col("bx")) % 11
    blocks = other.blocks()
    cut = F.expr("substring(payload, 1, octet_length(payload) - 3)")
    broken = blocks.where(rule != 1).withColumns({"payload": F.when(rule == 0, cut).otherwise(F.col("payload")), "quality": F.when(rule == 2, F.col("quality") * 2).otherwise(F.col("quality"))})
    broken = materialize(broken, "broken")
    out = Archive.create(spark, scratch_path(spark, "damaged"), store.geometry)
    out._write_blocks(broken)
    other.chunks().select(*CHUNK_KEYS, "version", "state", "nibbles", "hash").write.mode("append").parquet(f"{out.path}/chunks")
    return out


BLOCKS = f"{VOX64}, b AS (SELECT DISTINCT z // 16 AS bz, y // 16 AS by_, x // 16 AS bx FROM vox WHERE v > 0), r AS (SELECT *, (bz * 7 + by_ * 3 + bx) % 11 AS rule FROM b)"


@query("c15_verify_store", f"{BLOCKS} SELECT DISTINCT CAST(0 AS INTEGER) AS lod, CAST(bz // 2 AS INTEGER) AS cz, CAST(by_ // 2 AS INTEGER) AS cy, CAST(bx // 2 AS INTEGER) AS cx FROM r WHERE rule <= 2")
def c15(spark, sf):
    """Exactly the chunks that were damaged, found by their chained hashes; some of the damage decodes."""
    return damaged(spark, sf).verify()


@query("c2_failed_reads", f"{BLOCKS} SELECT CAST(bz AS INTEGER) AS bz, CAST(by_ AS INTEGER) AS by, CAST(bx AS INTEGER) AS bx, CAST(CASE WHEN rule = 0 THEN -1 ELSE 1 END AS INTEGER) AS state FROM r WHERE rule <> 1")
def c2_failed(spark, sf):
    """Blocks that are there (1) and blocks whose read fails (-1): damage is told apart from absence."""
    return damaged(spark, sf).read_states()


@query("s12_observed_run", f"{BLOCKS} SELECT count(*) FILTER (rule <> 1) AS blocks, count(*) FILTER (rule = 0) AS errors, CAST(count(*) FILTER (rule > 1) AS BIGINT) AS decoded FROM r")
def s12_observed(spark, sf):
    """What one pass over a damaged store saw, observed while it ran."""
    return damaged(spark, sf).observed_decode().select("blocks", "errors", "decoded")


@query("u1_voxel_sink", f"{VOX64} SELECT z, y, x, v FROM vox WHERE v > 0 AND z < 32")
def u1(spark, sf):
    """Voxels emitted block by block by a table function in SQL, over a partitioned table argument."""
    from ..sources.sinks import voxel_rows

    store = _archive(spark, sf)
    return voxel_rows(store.decoded(store.blocks().where("cz = 0")), store.geometry.block)


@query("b14_stored_hash", f"{VOX64} SELECT DISTINCT CAST(z // 32 AS INTEGER) AS cz, CAST(y // 32 AS INTEGER) AS cy, CAST(x // 32 AS INTEGER) AS cx FROM vox WHERE v = 251")
def b14_stored(spark, sf):
    """Chunks whose stored hash differs between a volume and one in which 251 has become 250."""
    one = _archive(spark, sf)
    other = Archive.create(spark, scratch_path(spark, "changed"), one.geometry)
    other.append(vox(spark, sf, 64).withColumn("v", F.when(F.col("v") == 251, 250).otherwise(F.col("v"))), exact=True)
    keys = ["cz", "cy", "cx"]
    return one.chunks().select(*keys, "hash").join(other.chunks().select(*keys, F.col("hash").alias("now")), keys).where("hash <> now").select(*keys)


@query("b6b_exact_residuals", f"{VOX64} SELECT z, y, x, v FROM vox WHERE v > 0")
def b6b(spark, sf):
    """A store of low quality with residuals: the volume comes back exactly."""
    store = Archive.create(spark, scratch_path(spark, "exact"), Geometry(64, 64, 64, 16, 32, 24.0))
    store.append(vox(spark, sf, 64), exact=True)
    return store.region(0, 0, 0, 64, 64, 64)


_STEP = "SELECT z // 2 AS z, y // 2 AS y, x // 2 AS x, (CAST(sum(v) AS BIGINT) + count(*) // 2) // count(*) AS v FROM {0} WHERE v > 0 GROUP BY 1, 2, 3"


@query("g2_pyramid_upkeep", f"""{VOX64}, a AS (SELECT z, y, x, CASE WHEN z < 32 AND y < 32 THEN greatest(v - 100, 0) WHEN z >= 48 AND x < 16 THEN 0 WHEN z >= 32 AND x < 32 AND v > 0 THEN 255 - v // 2 ELSE v END AS v FROM vox),
l1 AS ({_STEP.format("a")}), l2 AS ({_STEP.format("l1")})
SELECT CAST(1 AS INTEGER) AS lod, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(v AS INTEGER) AS v FROM l1 UNION ALL SELECT 2, CAST(z AS INTEGER), CAST(y AS INTEGER), CAST(x AS INTEGER), CAST(v AS INTEGER) FROM l2""")
def g2_upkeep(spark, sf):
    """Levels after three appends, of which the second and third change some chunks: kept up chunk by chunk, never built anew."""
    store = Archive.create(spark, scratch_path(spark, "upkeep"), Geometry(64, 64, 64, 8, 16, LOSSLESS, 0, 3))
    volume = vox(spark, sf, 64)
    store.update(volume, exact=True)
    store.update(volume.where("z < 32 AND y < 32").withColumn("v", F.greatest(F.col("v") - 100, F.lit(0))), exact=True)
    third = volume.where("z >= 32 AND x < 32")
    store.update(third.withColumn("v", F.expr("CASE WHEN z >= 48 AND x < 16 THEN 0 WHEN v > 0 THEN 255 - v DIV 2 ELSE v END").cast("int")), exact=True)
    return store.region(0, 0, 0, 64, 64, 64, 1).select(F.lit(1).alias("lod"), *AXES, "v").unionByName(store.region(0, 0, 0, 64, 64, 64, 2).select(F.lit(2).alias("lod"), *AXES, "v"))


@query("c5_block_bytes")
def c5(spark, sf):
    """Compressed size of every block."""
    return _archive(spark, sf).blocks().select("bz", "by", "bx", F.octet_length("payload").alias("n_bytes"))



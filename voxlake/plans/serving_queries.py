"""Queries of block serving: the access log against the derived volume's blocks, which are the catalog's level 0."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codec as B
from ..operators import serving as S
from ..operators import volume as V
from ..sources.volumes import vox, vox_sql
from .access_queries import LOG, log
from .register import query

EDGE = 4
#: Blocks of level 0: 1 with material, 2 all air; no row: never written.
CATALOG = f"""vox AS ({vox_sql(64)}), catalog AS (SELECT 0 AS lod, z // {EDGE} AS bz, y // {EDGE} AS by_, x // {EDGE} AS bx, CASE WHEN max(v) > 0 THEN 1 ELSE 2 END AS state, CAST(sum(v) AS BIGINT) AS total FROM vox GROUP BY ALL)"""
#: Resident: what the even requests named.
RESIDENT = "resident AS (SELECT DISTINCT lod, bz, by_, bx FROM log WHERE seq % 2 = 0)"
ROW = "CAST(lod AS INTEGER) AS lod, CAST(bz AS INTEGER) AS bz, CAST(by_ AS INTEGER) AS by, CAST(bx AS INTEGER) AS bx"


def catalog(spark, sf):
    return V.block_stats(vox(spark, sf, 64), EDGE).select(F.lit(0).alias("lod"), "bz", "by", "bx", F.when(F.col("present"), 1).otherwise(2).alias("state"))


def resident(spark, sf):
    return log(spark, sf).where("seq % 2 = 0").select(*S.BLOCK).distinct()


@query("s1_byte_budget", f"""WITH {LOG}, b AS (SELECT lod, bz, by_, bx, max(seq) AS last_seq FROM log GROUP BY ALL),
u AS (SELECT *, sum(64 + (bz * 7 + by_ * 3 + bx) % 50) OVER (ORDER BY last_seq DESC, lod, bz, by_, bx) AS used FROM b)
SELECT {ROW}, last_seq, CAST(used AS BIGINT) AS used FROM u WHERE used <= 100000""")
def s1(spark, sf):
    """The blocks that a cache of 100,000 bytes would hold by recency."""
    rows = log(spark, sf)
    sizes = rows.select(*S.BLOCK).distinct().withColumn("n_bytes", (64 + (F.col("bz") * 7 + F.col("by") * 3 + F.col("bx")) % 50).cast("long"))
    return S.within_budget(rows, sizes, 100_000)


@query("s2_contains", f"WITH {LOG}, {RESIDENT}, w AS (SELECT DISTINCT lod, bz, by_, bx FROM log) SELECT {ROW}, (lod, bz, by_, bx) IN (SELECT (lod, bz, by_, bx) FROM resident) AS resident FROM w")
def s2(spark, sf):
    return S.contains(log(spark, sf).select(*S.BLOCK).distinct(), resident(spark, sf))


def _prefetch_sql(where):
    return f"WITH {LOG}, {RESIDENT}, {CATALOG} SELECT {ROW} FROM catalog c WHERE state = 1 AND {where} AND NOT EXISTS (SELECT 1 FROM resident r WHERE r.lod = c.lod AND r.bz = c.bz AND r.by_ = c.by_ AND r.bx = c.bx)"


@query("s2_prefetch_chunk", _prefetch_sql("bz // 4 = 1 AND by_ // 4 = 2 AND bx // 4 = 0"))
def s2p(spark, sf):
    return S.to_prefetch(catalog(spark, sf), resident(spark, sf), S.in_chunk(1, 2, 0, 4))


@query("s9_prefetch_region", _prefetch_sql("bz BETWEEN 2 AND 7 AND by_ BETWEEN 0 AND 15 AND bx BETWEEN 5 AND 8"))
def s9r(spark, sf):
    """Blocks that a box of voxels touches."""
    return S.to_prefetch(catalog(spark, sf), resident(spark, sf), S.in_region((10, 0, 22, 20, 64, 14), EDGE))


@query("s9_prefetch_level", _prefetch_sql("lod = 0"))
def s9l(spark, sf):
    return S.to_prefetch(catalog(spark, sf), resident(spark, sf), F.col("lod") == 0)


@query("s2_invalidate_chunk", f"WITH {LOG}, {RESIDENT} SELECT {ROW} FROM resident WHERE NOT (lod = 0 AND bz // 4 = 1 AND by_ // 4 = 2 AND bx // 4 = 0)")
def s2i(spark, sf):
    return S.invalidate(resident(spark, sf), S.in_chunk(1, 2, 0, 4))


@query("s6_freeze_thaw", f"""WITH {LOG}, t AS (SELECT *, CAST(floor(seq / 1000) AS BIGINT) AS tick FROM log), f AS (SELECT lod, bz, by_, bx, min(tick) AS first FROM t GROUP BY ALL),
p AS (SELECT tick, lod, bz, by_, bx, count(*) AS n, any_value(first) AS first FROM t JOIN f USING (lod, bz, by_, bx) GROUP BY ALL)
SELECT tick, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_blocks, CAST(sum(CASE WHEN first < tick THEN n ELSE 0 END) AS BIGINT) AS hits, count(*) FILTER (first = tick) AS admitted FROM p GROUP BY tick""")
def s6(spark, sf):
    """Ticks of 1,000 requests: the resident set is frozen within each."""
    return S.ticks(log(spark, sf), 1000)


@query("s3_batch_update", f"""WITH {LOG}, {CATALOG}, w AS (SELECT DISTINCT CAST(floor(seq / 1000) AS BIGINT) AS tick, lod, bz, by_, bx FROM log)
SELECT tick, count(*) AS n_unique, count(*) FILTER (state = 1) AS present, count(*) FILTER (state = 2) AS zero, count(*) FILTER (state IS NULL) AS absent FROM w LEFT JOIN catalog USING (lod, bz, by_, bx) GROUP BY tick""")
def s3(spark, sf):
    return S.batch_update(log(spark, sf), catalog(spark, sf), 1000)


@query("s7_serve_data", f"""WITH {LOG}, {CATALOG} SELECT seq, CAST(coalesce(state, 0) AS INTEGER) AS state, CASE WHEN state IS NOT NULL THEN {EDGE**3} END AS n_bytes, CASE WHEN state = 1 THEN total WHEN state = 2 THEN 0 END AS total
FROM log LEFT JOIN catalog USING (lod, bz, by_, bx)""")
def s7(spark, sf):
    """Every request with the block it gets: its size, and the sum of its bytes."""
    blocks = B.pack_blocks(vox(spark, sf, 64), EDGE).withColumn("lod", F.lit(0))
    served = S.serve_blocks(log(spark, sf), catalog(spark, sf), blocks, EDGE)
    digits = F.sequence(F.lit(0), F.lit(EDGE**3 - 1))
    total = F.aggregate(digits, F.lit(0).cast("long"), lambda a, k: a + F.conv(F.hex(F.substring("data", k + 1, 1)), 16, 10).cast("long"))
    return served.select("seq", "state", F.octet_length("data").alias("n_bytes"), F.when(F.col("data").isNotNull(), total).alias("total"))


@query("s12_level_stats", f"""WITH {LOG}, {CATALOG}, h AS (SELECT lod, count(*) FILTER (state = 1) AS present, count(*) FILTER (state = 2) AS zero FROM catalog GROUP BY lod),
a AS (SELECT lod, count(*) AS requests, count(DISTINCT (bz, by_, bx)) AS blocks_asked FROM log GROUP BY lod)
SELECT CAST(lod AS INTEGER) AS lod, coalesce(present, 0) AS present, coalesce(zero, 0) AS zero, coalesce(requests, 0) AS requests, coalesce(blocks_asked, 0) AS blocks_asked FROM h FULL JOIN a USING (lod)""")
def s12(spark, sf):
    return S.level_stats(catalog(spark, sf), log(spark, sf))

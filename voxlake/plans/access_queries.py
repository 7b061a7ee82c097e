"""Queries of the access log, in batch; the streaming forms are tested against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access as S
from ..sources.volumes import read_table
from .register import query

LOG = "log AS (SELECT event_id AS seq, ts, CAST(user_id % 3 AS INTEGER) AS lod, CAST(event_id % 16 AS INTEGER) AS bz, CAST(user_id % 16 AS INTEGER) AS by_, CAST((event_id + user_id) % 16 AS INTEGER) AS bx FROM events)"


def log(spark, sf):
    return S.access_log(read_table(spark, sf, "events"))


#: Slots of a shard, and from how many on its small queue gives entries up.
SLOTS, SMALL_LEAST = 16, 16 // 10 + 1
KEYED = "keyed AS (SELECT seq, CAST(lod * 4096 + bz * 256 + by_ * 16 + bx AS BIGINT) AS key FROM log), a AS (SELECT key % 16 AS shard, key, row_number() OVER (PARTITION BY key % 16 ORDER BY seq) AS k FROM keyed)"

#: A row per access: the ring, who was used, and the hand; ``d`` is how far the hand goes to find a victim.
CLOCK = f"""WITH RECURSIVE {LOG}, {KEYED},
s AS (SELECT shard, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS ring, CAST([] AS BOOLEAN[]) AS used, CAST(0 AS BIGINT) AS hand, CAST(0 AS BIGINT) AS hits, CAST(0 AS BIGINT) AS evictions FROM (SELECT DISTINCT shard FROM a)
UNION ALL SELECT shard, k, CASE WHEN place > 0 THEN ring WHEN d IS NULL THEN list_append(ring, key) ELSE list_transform(range({SLOTS}), lambda p: CASE WHEN p = (hand + d) % {SLOTS} THEN key ELSE ring[p + 1] END) END,
  CASE WHEN place > 0 THEN list_transform(range(len(used)), lambda p: CASE WHEN p + 1 = place THEN true ELSE used[p + 1] END) WHEN d IS NULL THEN list_append(used, true)
    ELSE list_transform(range({SLOTS}), lambda p: CASE WHEN p = (hand + d) % {SLOTS} THEN true WHEN (p - hand + {SLOTS}) % {SLOTS} < d THEN false ELSE used[p + 1] END) END,
  CASE WHEN d IS NULL THEN hand ELSE (hand + d + 1) % {SLOTS} END, hits + CASE WHEN place > 0 THEN 1 ELSE 0 END, evictions + CASE WHEN d IS NULL THEN 0 ELSE 1 END
FROM (SELECT *, CASE WHEN place = 0 AND len(ring) = {SLOTS} THEN coalesce(list_min(list_filter(range({SLOTS}), lambda x: NOT used[(hand + x) % {SLOTS} + 1])), {SLOTS}) END AS d
  FROM (SELECT s.shard, a.k, a.key, s.ring, s.used, s.hand, s.hits, s.evictions, coalesce(list_position(s.ring, a.key), 0) AS place FROM s JOIN a ON a.shard = s.shard AND a.k = s.k + 1)))
SELECT CAST(shard AS INTEGER) AS shard, max(k) AS n, max(hits) AS hits, max(k) - max(hits) AS misses, max(evictions) AS evictions FROM s GROUP BY shard"""

#: A row per small step: an access that hits or finds room ends, else one entry moves or leaves and it is tried again.
S3FIFO = f"""WITH RECURSIVE {LOG}, {KEYED},
s AS (SELECT shard, CAST(1 AS BIGINT) AS k, CAST([] AS STRUCT(key BIGINT, f INTEGER)[]) AS small, CAST([] AS STRUCT(key BIGINT, f INTEGER)[]) AS main, CAST([] AS BIGINT[]) AS ghost, CAST(0 AS BIGINT) AS hits, CAST(0 AS BIGINT) AS evictions FROM (SELECT DISTINCT shard FROM a)
UNION ALL SELECT shard, CASE WHEN act IN ('hit', 'add') THEN k + 1 ELSE k END,
  CASE act WHEN 'hit' THEN list_transform(small, lambda e: {{'key': e.key, 'f': CASE WHEN e.key = asked THEN least(e.f + 1, 3) ELSE e.f END}}) WHEN 'add' THEN CASE WHEN known THEN small ELSE list_append(small, {{'key': asked, 'f': 0}}) END
    WHEN 'promote' THEN small[2:] WHEN 'drop_small' THEN small[2:] ELSE small END,
  CASE act WHEN 'hit' THEN list_transform(main, lambda e: {{'key': e.key, 'f': CASE WHEN e.key = asked THEN least(e.f + 1, 3) ELSE e.f END}}) WHEN 'add' THEN CASE WHEN known THEN list_append(main, {{'key': asked, 'f': 0}}) ELSE main END
    WHEN 'promote' THEN list_append(main, {{'key': small[1].key, 'f': 0}}) WHEN 'again' THEN list_append(main[2:], {{'key': main[1].key, 'f': main[1].f - 1}}) WHEN 'drop_main' THEN main[2:] ELSE main END,
  CASE act WHEN 'drop_small' THEN list_slice(list_append(list_filter(ghost, lambda g: g <> small[1].key), small[1].key), -{SLOTS}, -1) ELSE ghost END,
  hits + CASE act WHEN 'hit' THEN 1 ELSE 0 END, evictions + CASE WHEN act IN ('drop_small', 'drop_main') THEN 1 ELSE 0 END
FROM (SELECT s.*, a.key AS asked, list_contains(s.ghost, a.key) AS known,
  CASE WHEN len(list_filter(s.small, lambda e: e.key = a.key)) + len(list_filter(s.main, lambda e: e.key = a.key)) > 0 THEN 'hit' WHEN len(s.small) + len(s.main) < {SLOTS} THEN 'add'
    WHEN len(s.small) >= {SMALL_LEAST} OR len(s.main) = 0 THEN CASE WHEN s.small[1].f > 0 AND len(s.small) + len(s.main) > 1 THEN 'promote' ELSE 'drop_small' END
    WHEN s.main[1].f > 0 THEN 'again' ELSE 'drop_main' END AS act FROM s JOIN a ON a.shard = s.shard AND a.k = s.k))
SELECT CAST(shard AS INTEGER) AS shard, max(k) - 1 AS n, max(hits) AS hits, max(k) - 1 - max(hits) AS misses, max(evictions) AS evictions FROM s GROUP BY shard"""


def _replay(policy, sql):
    @query(f"s4_cache_replay_{policy}", sql)
    def run(spark, sf):
        keyed = log(spark, sf).select("seq", S.block_key())
        return S.replay(keyed.withColumn("shard", F.col("key") % 16), 16 * SLOTS, policy, 16)

    return run


_replay("s3fifo", S3FIFO)
_replay("clock", CLOCK)


@query("g15_cache_counters", "SELECT CAST(count(*) AS BIGINT) AS n FROM events")
def g15(spark, sf):
    """Counters summed over shards; hits and misses add up to the accesses."""
    total = S.counters(S.replay(log(spark, sf).select("seq", S.block_key()), 16 * SLOTS, "s3fifo", 16))
    return total.select((F.col("hits") + F.col("misses")).alias("n"))


@query("s5_distinct_misses", f"WITH {LOG} SELECT lod, bz, by_ AS by, bx, min(seq) AS first_seq FROM log WHERE NOT (lod = 1 AND bz < 8) GROUP BY ALL")
def s5(spark, sf):
    rows = log(spark, sf)
    resident = rows.where("lod = 1 AND bz < 8").select("lod", "bz", "by", "bx").distinct()
    return S.distinct_misses(rows, resident)


@query("s7_serve_blocks", f"WITH {LOG} SELECT CAST(CASE WHEN (bz + by_ + bx) % 3 = 0 THEN 1 WHEN (bz + by_ + bx) % 3 = 1 THEN 2 ELSE 0 END AS INTEGER) AS state, count(*) AS n FROM log GROUP BY 1")
def s7(spark, sf):
    rows = log(spark, sf)
    kind = F.expr("(bz + by + bx) % 3")
    chunks = rows.where(kind < 2).select("lod", "bz", "by", "bx", F.when(kind == 0, 1).otherwise(2).alias("state")).distinct()
    return S.serve(rows, chunks).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("s8_request_queue", f"WITH {LOG} SELECT lod, bz, by_ AS by, bx, max(seq) AS last_seq FROM log GROUP BY ALL ORDER BY last_seq DESC LIMIT 50")
def s8(spark, sf):
    """A report of the 50 newest requests, each region once."""
    return S.request_queue(log(spark, sf), 50)


@query("s10_region_generations", f"WITH {LOG} SELECT lod, bz, by_ AS by, bx, max(seq) AS generation FROM log GROUP BY ALL UNION ALL SELECT NULL, NULL, NULL, NULL, max(seq) FROM log")
def s10(spark, sf):
    return S.region_generations(log(spark, sf))


RANGES = "ranges AS (SELECT l_suppkey % 4 AS file, l_orderkey * 700 AS start, CAST(l_quantity * 10 AS BIGINT) AS length FROM lineitem)"


def ranges(spark, sf):
    return read_table(spark, sf, "lineitem").select((F.col("l_suppkey") % 4).alias("file"), (F.col("l_orderkey") * 700).alias("start"), (F.col("l_quantity") * 10).cast("long").alias("length"))


@query("s11_coalesce_ranges", f"""WITH {RANGES}, r AS (SELECT *, max(start + length) OVER (PARTITION BY file ORDER BY start, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranges),
s AS (SELECT *, sum(CASE WHEN start <= reach + 2000 THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY start, length RANGE UNBOUNDED PRECEDING) AS run FROM r)
SELECT file, min(start) AS run_start, max(start + length) AS run_end, count(*) AS n FROM s GROUP BY file, run""")
def s11(spark, sf):
    return S.coalesce_ranges(ranges(spark, sf), ["file"], 2000)


@query("s11_coalesce_ranges_capped", f"""WITH RECURSIVE {RANGES}, r AS (SELECT *, max(start + length) OVER (PARTITION BY file ORDER BY start, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranges),
s AS (SELECT *, sum(CASE WHEN start <= reach + 2000 THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY start, length RANGE UNBOUNDED PRECEDING) AS run FROM r),
k AS (SELECT file, run, start, start + length AS stop, row_number() OVER (PARTITION BY file, run ORDER BY start, length) AS k FROM s),
f AS (SELECT file, run, k, start AS first, stop AS last, 1 AS part FROM k WHERE k = 1 UNION ALL
  SELECT k.file, k.run, k.k, CASE WHEN k.stop - f.first <= 20000 THEN f.first ELSE k.start END, CASE WHEN k.stop - f.first <= 20000 THEN greatest(f.last, k.stop) ELSE k.stop END, f.part + CASE WHEN k.stop - f.first <= 20000 THEN 0 ELSE 1 END
  FROM f JOIN k ON k.file = f.file AND k.run = f.run AND k.k = f.k + 1)
SELECT file, first AS run_start, max(last) AS run_end, count(*) AS n FROM f GROUP BY file, run, part, first""")
def s11c(spark, sf):
    return S.coalesce_ranges(ranges(spark, sf), ["file"], 2000, 20_000)

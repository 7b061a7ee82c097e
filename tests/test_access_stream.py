from pyspark.sql import functions as F

from voxlake.operators import access as S
from voxlake.plans.registry import QUERIES
from voxlake.streaming import access_stream as X


def test_a_scan_does_not_flush_the_hot_set():
    hot, scan = list(range(40)), list(range(1000, 1400))
    hits = {}
    for name, kind in S.POLICIES.items():
        cache, n = kind(64), 0
        for round_ in range(30):
            for k in hot * 2 + scan[round_ * 13 % 300 :][:60]:
                n += cache.access(k)
        hits[name] = n
    assert hits["s3fifo"] > hits["clock"] > 0


def test_nothing_is_evicted_while_there_is_room():
    for kind in S.POLICIES.values():
        cache = kind(10)
        assert [cache.access(k) for k in [*range(10), *range(10)]] == [False] * 10 + [True] * 10 and cache.evictions == 0


def test_replay_ignores_partitioning(spark, small):
    log = S.access_log(spark.read.parquet(f"{small}/events.parquet")).select("seq", S.block_key())
    one, two = (sorted(map(tuple, S.replay(d, 256, "clock", 8).collect())) for d in (log, log.repartition(9)))
    assert one == two and sum(r[1] for r in one) == log.count()


def test_runs_are_capped_greedily(spark):
    rows = spark.createDataFrame([(0, s, 10) for s in (0, 10, 20, 30, 500)], "f int, start long, length long")
    got = sorted(map(tuple, S.coalesce_ranges(rows, ["f"], 5, 25).collect()))
    assert got == [(0, 0, 20, 2), (0, 20, 40, 2), (0, 500, 510, 1)]
    assert sorted(map(tuple, S.coalesce_ranges(rows, ["f"], 5).collect())) == [(0, 0, 40, 4), (0, 500, 510, 1)]


def test_ranges_are_all_order_lines(spark, small):
    """Both queries against a loop over the sorted ranges of the whole table."""
    files = {}
    for supplier, order, quantity in spark.read.parquet(f"{small}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_quantity").collect():
        files.setdefault(supplier % 4, []).append((order * 700, int(quantity * 10)))
    for name, longest in (("s11_coalesce_ranges", None), ("s11_coalesce_ranges_capped", 20_000)):
        want = []
        for file, rows in files.items():
            runs, reach = [], None
            for start, length in sorted(rows):
                end = start + length
                joined = reach is not None and start <= reach + 2000
                if joined and (longest is None or end - runs[-1][1] <= longest):
                    runs[-1] = (file, runs[-1][1], max(runs[-1][2], end), runs[-1][3] + 1)
                else:
                    runs.append((file, start, end, 1))
                reach = end if reach is None else max(reach, end)
            want += runs
        got = sorted(map(tuple, QUERIES[name](spark, small).select("file", "run_start", "run_end", "n").collect()))
        assert got == sorted(want) and len(got) > 4
        assert sum(r[3] for r in got) == spark.read.parquet(f"{small}/lineitem.parquet").count()


def run_stream(spark, frame, mode, name, tmp_path):
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}").start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}")


def streamed(spark, small):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    return S.access_log(spark.readStream.schema(schema).parquet(f"{small}/events.parquet*"))


def test_streams_equal_the_batch(spark, small, tmp_path):
    batch = S.access_log(spark.read.parquet(f"{small}/events.parquet"))
    got = run_stream(spark, X.generations(streamed(spark, small)), "complete", "gens", tmp_path)
    want = S.region_generations(batch).where("lod IS NOT NULL")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    got = run_stream(spark, X.windowed_counts(streamed(spark, small)), "update", "wins", tmp_path)
    want = batch.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "lod").count().select("w.start", "lod", "count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    got = run_stream(spark, X.replay_stream(streamed(spark, small).select("seq", S.block_key()), 256, "s3fifo", 8), "update", "cache", tmp_path)
    want = S.replay(batch.select("seq", S.block_key()), 256, "s3fifo", 8)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    got = run_stream(spark, X.first_misses(streamed(spark, small), "60 days"), "append", "firsts", tmp_path)
    assert got.count() == batch.select(*X.REGION).distinct().count()

    got = run_stream(spark, X.sessions(streamed(spark, small)), "append", "sess", tmp_path)
    assert set(got.columns) == {"start", "end", "lod", "n"}

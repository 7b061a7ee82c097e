import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxlake.operators import codec as B
from voxlake.operators import codec
from voxlake.sources import one_file
from voxlake.sources import store as store_module
from voxlake.sources import surface_files as S
from voxlake.sources import zarr2
from voxlake.streaming import pyramid_stream
from voxlake.sources.store import Archive, Geometry, probe
from voxlake.sources.volumes import volume_from_function


def ball(n=32):
    z, y, x = np.mgrid[:n, :n, :n] - (n - 1) / 2
    r = np.sqrt(z * z + y * y + x * x)
    return np.where(r > 0.4 * n, 0, np.clip(128 + 100 * np.cos(0.6 * r), 1, 255)).astype(np.uint8)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 7), st.integers(0, 2**32 - 1))
def test_the_bound_holds_for_any_block(level, seed):
    rng = np.random.default_rng(seed)
    blocks = rng.integers(0, 256, (2, 16, 16, 16)).astype(np.uint8)
    codec = B.Codec.preset(level)
    back = B.decode_blocks(B.encode_blocks(blocks, codec), codec)
    assert np.abs(back.astype(int) - blocks).max() <= codec.max_error


def test_air_blocks_have_no_payload_and_constants_are_exact():
    blocks = np.stack([np.zeros((16, 16, 16), np.uint8), np.full((16, 16, 16), 77, np.uint8)])
    codec = B.Codec.of(8.0)
    coded = B.encode_blocks(blocks, codec)
    assert coded[0] is None and (B.decode_blocks(coded, codec) == blocks).all()


def test_better_quality_has_a_smaller_error():
    blocks = ball().reshape(2, 16, 2, 16, 2, 16).transpose(0, 2, 4, 1, 3, 5).reshape(-1, 16, 16, 16)
    errors = [np.abs(B.decode_blocks(B.encode_blocks(blocks, B.Codec.of(q)), B.Codec.of(q)).astype(int) - blocks).mean() for q in (1, 6, 24)]
    assert errors == sorted(errors)


def test_quality_is_checked():
    assert B.Codec.of(float("nan")).quality == 8 and B.Codec.of(-1).quality == 8 and B.Codec.of(2000).quality == 8
    assert B.Codec.preset(99) == B.Codec.preset(B.STREAMING)


def test_dct_is_orthonormal():
    b = B.dct_basis(16)
    assert np.allclose(b @ b.T, np.eye(16))


def test_damaged_payload_is_noticed():
    codec = B.Codec.of(4.0)
    payload = B.encode_blocks(np.full((1, 16, 16, 16), 9, np.uint8), codec)[0]
    with pytest.raises(Exception):
        B.decode_blocks([payload[:-3]], codec)


def test_archive_appends_reopens_and_verifies(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    v = volume_from_function(spark, 32, 32, 32, F.col("z") + F.col("y") + F.col("x") + 1)
    Archive.create(spark, path, Geometry(32, 32, 32, 16, 32, 0.01, 1), "notes").append(v)
    store = Archive.open(spark, path, (32, 32, 32))
    assert store.metadata == "notes" and probe(spark, path).quality == 0.01
    assert store.region(3, 4, 5, 2, 2, 2).where("abs(v - (z + y + x + 1)) > 1").count() == 0
    assert {r["state"] for r in store.coverage().collect()} == {1} and store.verify().count() == 0
    store.append(v.where("z < 32").withColumn("v", F.lit(0)))
    assert {r["state"] for r in store.coverage().collect()} == {2} and store.region(0, 0, 0, 32, 32, 32).count() == 0
    with pytest.raises(ValueError):
        Archive.open(spark, path, (1, 2, 3))
    with pytest.raises(ValueError):
        store.set_metadata("x" * 200_000)


def test_rate_target_is_within_its_limits(spark):
    v = volume_from_function(spark, 32, 32, 32, (F.col("z") * 7 + F.col("y") * 5 + F.col("x") * 3) % 200 + 1)
    packed = B.pack_blocks(v)
    low, high = (B.quality_for_ratio(packed, B.Codec.of(6.0), r) for r in (2.0, 200.0))
    assert 0.5 <= low <= high <= 24


def table_of(spark, data):
    return spark.createDataFrame([(*map(int, p), int(data[tuple(p)])) for p in np.argwhere(data)], "z int, y int, x int, v int")


@pytest.mark.parametrize("codec", ["raw", "blosc"])
def test_zarr_levels_read_as_chunks(spark, tmp_path, codec):
    data = ball(32)
    for lod, edge in ((0, 16), (1, 8)):
        part = data[:: lod + 1, :: lod + 1, :: lod + 1]
        zarr2.write_level(table_of(spark, part), str(tmp_path), lod, part.shape, edge, codec, "/" if lod else ".", 600)
    meta = zarr2.geometry(spark, str(tmp_path))
    assert zarr2.n_levels(spark, str(tmp_path)) == 2 and meta["grid"] == (2, 2, 2)
    assert zarr2.key_of(zarr2.geometry(spark, str(tmp_path), 1), 1, 0, 1, 2) == "1/0/1/2"
    level = zarr2.read_level(spark, str(tmp_path))
    got = np.zeros_like(data)
    for r in zarr2.voxels(level, 16).collect():
        got[r["z"], r["y"], r["x"]] = r["v"]
    assert (got == data).all()
    assert zarr2.read_pyramid(spark, str(tmp_path)).where("lod = 1").count() == 8
    assert zarr2.read_level(spark, str(tmp_path), 0, "cz = 1 AND cx >= 1").count() == 2
    for box in ((3, 4, 5, 20, 9, 17), (15, 0, 0, 2, 32, 32), (-5, -5, 30, 8, 60, 8)):
        rows, cost = zarr2.region(spark, str(tmp_path), *box)
        here = tuple(slice(max(a, 0), a + n) for a, n in zip(box[:3], box[3:], strict=True))
        want = {(z, y, x, int(data[z, y, x])) for z, y, x in np.argwhere(data).tolist() if all(s.start <= c < s.stop for c, s in zip((z, y, x), here, strict=True))}
        assert {tuple(r) for r in rows.collect()} == want
        if codec == "raw":
            assert all(r["fetched"] < r["length"] for r in cost.where("key LIKE '0/0.%'").collect()) if box[0] else True


def test_a_range_of_a_frame_reads_only_its_blocks():
    data = np.random.default_rng(0).integers(0, 5, 10_000).astype(np.uint8).tobytes()
    for frame in (zarr2.blosc_encode(data, 1000), struct_frame(data)):
        for start, length in ((0, 1), (999, 2), (2500, 3100), (9_999, 1), (0, 10_000)):
            spent = []

            def read(a, n, frame=frame, spent=spent):
                spent.append(n)
                return frame[a : a + n]

            assert zarr2.blosc_range(read, start, length) == data[start : start + length]
            assert length > 2000 or sum(spent) < 3000


def struct_frame(data):
    """A frame that is stored whole."""
    import struct

    return struct.pack("<BBBBIII", 2, 1, 0x92, 1, len(data), 1000, 16 + len(data)) + data


def test_planning_follows_what_is_stored(spark, tmp_path):
    """A grid of 8 million chunks with two objects, one of them far out."""
    rows = spark.createDataFrame([(0, 0, 0, 7), (1599, 3, 1590, 9)], "z int, y int, x int, v int")
    assert zarr2.write_level(rows, str(tmp_path), 0, (1600, 1600, 1600), 8) == 2
    assert zarr2.stored(spark, str(tmp_path)).count() == 2
    meta = zarr2.geometry(spark, str(tmp_path))
    got = zarr2.voxels(zarr2.fetched(zarr2.stored(spark, str(tmp_path)), str(tmp_path), meta), 8).drop("lod").collect()
    assert {tuple(r) for r in got} == {(0, 0, 0, 7), (1599, 3, 1590, 9)}
    assert zarr2.region(spark, str(tmp_path), 1590, 0, 1580, 20, 20, 20)[1].count() == 1


def test_missing_zarr_chunk_is_air_and_a_short_one_fails(spark, tmp_path):
    data = np.zeros((16, 16, 16), np.uint8)
    data[8:, 8:, 8:] = 5
    zarr2.write_level(table_of(spark, data), str(tmp_path), 0, data.shape, 8)
    states = {tuple(r)[1:4]: r["state"] for r in zarr2.read_level(spark, str(tmp_path)).collect()}
    assert states[1, 1, 1] == 1 and states[0, 0, 0] == 2 and len(states) == 8
    (tmp_path / "0" / ".1.1.1.crc").unlink(missing_ok=True)
    (tmp_path / "0" / "1.1.1").write_bytes(b"short")
    with pytest.raises(Exception):
        zarr2.read_level(spark, str(tmp_path)).collect()


def test_zarr_rejects_what_it_does_not_know():
    for change in ({"zarr_format": 3}, {"chunks": [8, 8, 4]}, {"dtype": "<u2"}, {"compressor": {"id": "gzip"}}):
        import json

        meta = {"zarr_format": 2, "shape": [8, 8, 8], "chunks": [8, 8, 8], "dtype": "|u1", "compressor": None} | change
        with pytest.raises(ValueError):
            zarr2.read_meta(json.dumps(meta))


def grid7x5(spark):
    rows = spark.range(35).select(F.expr("CAST(id DIV 7 AS INT)").alias("gy"), (F.col("id") % 7).cast("int").alias("gx"))
    ok = ~((F.col("gx") == 2) & (F.col("gy") == 1))
    return rows.select("gy", "gx", *(F.when(ok, e).alias(c) for c, e in (("pz", 50 + F.col("gx") * 0.5), ("py", 200 + F.col("gy") * 4.0), ("px", 100 + F.col("gx") * 4.0))))


def test_obj_grid_round_trip(spark, tmp_path):
    S.save_obj_grid(grid7x5(spark).repartition(3), 7, 5, f"file://{tmp_path}/grid.obj")
    lines = (tmp_path / "grid.obj").read_text().splitlines()
    assert lines[0] == "# grid 7 5" and sum(x.startswith("v ") for x in lines) == 34 and sum(x.startswith("f ") for x in lines) == 2 * (24 - 4)
    assert [p.name for p in tmp_path.iterdir() if p.is_file() and p.name.startswith("grid")] == ["grid.obj"]
    back = S.load_obj_grid(spark, f"file://{tmp_path}/grid.obj")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, grid7x5(spark).where("pz IS NOT NULL").collect()))


def test_obj_mesh_fans_counts_back_and_drops(spark, tmp_path):
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nvn 0 0 1\nv 0 1 0\nf 1//1 2//1 3//1\nf -4 -3 -2 -1\nf 1 2 9\n")
    v, t = S.load_obj_mesh(spark, f"file://{tmp_path}/m.obj")
    assert v.count() == 4 and [tuple(r) for r in t.orderBy("tid").collect()] == [(0, 0, 1, 2), (1, 0, 1, 2), (2, 0, 2, 3)]
    S.save_obj_mesh(v.repartition(3), t.repartition(2), f"file://{tmp_path}/again.obj")
    assert (tmp_path / "again.obj").read_text() == "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1 2 3\nf 1 2 3\nf 1 3 4\n"


def test_a_text_in_many_splits_keeps_its_order(spark, tmp_path):
    """Vertex numbers and relative indices over splits of 1,000 bytes."""
    n = 700
    (tmp_path / "m.obj").write_text("".join(f"v {k} {k}.5 -1\nf -1 {k + 1} {max(k, 1)}\n" for k in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        v, t = S.load_obj_mesh(spark, f"file://{tmp_path}/m.obj")
        assert {r["vid"]: (r["x"], r["y"]) for r in v.collect()} == {k: (k, k + 0.5) for k in range(n)}
        assert sorted(map(tuple, t.collect())) == [(k, k, k, max(k, 1) - 1) for k in range(n)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_parts_that_do_not_follow_each_other_fail(spark, tmp_path):
    rows = spark.createDataFrame([(0, b"abc"), (3, b"d"), (5, b"e")], "offset long, data binary")
    with pytest.raises(Exception):
        one_file.write_file(rows, f"file://{tmp_path}/x")
    assert not (tmp_path / "x").exists()
    one_file.write_file(rows.where("offset < 5").repartition(4), f"file://{tmp_path}/x")
    assert (tmp_path / "x").read_bytes() == b"abcd"


def test_raw_box_round_trip(spark, tmp_path):
    data = ball(16)
    S.save_raw(table_of(spark, data), (2, -3, 4, 9, 10, 14), f"file://{tmp_path}/box.raw")
    want = np.zeros((9, 10, 14), np.uint8)
    want[:, 3:, :12] = data[2:11, :7, 4:]
    assert (tmp_path / "box.raw").read_bytes() == want.tobytes()
    got = {tuple(r) for r in S.load_raw(spark, f"file://{tmp_path}/box.raw", (9, 10, 14)).collect()}
    assert got == {(*map(int, p), int(want[tuple(p)])) for p in np.argwhere(want)}


def test_pixel_map_round_trip(spark, tmp_path):
    S.save_pixel_map(grid7x5(spark), 7, 5, f"file://{tmp_path}/map.vc")
    head, _, body = (tmp_path / "map.vc").read_bytes().partition(b"<>\n")
    assert b"width: 7\n" in head and len(body) == 35 * 48 and np.frombuffer(body, "<f8")[:3].tolist() == [100, 200, 50]
    back = S.load_pixel_map(spark, f"file://{tmp_path}/map.vc", 3.0)
    rows = {(r["gy"], r["gx"]): r for r in back.collect()}
    assert rows[1, 2]["pz"] is None and rows[1, 2]["depth"] == 0 and rows[4, 6]["px"] == 124.0 and rows[4, 6]["depth"] == 3.0


def test_ppm(spark, tmp_path):
    image = spark.createDataFrame([(0, 0, 7), (0, 1, 9)], "i int, j int, val int")
    S.save_ppm(image, 2, 2, f"file://{tmp_path}/i.ppm")
    assert (tmp_path / "i.ppm").read_bytes() == b"P6\n2 2\n255\n" + bytes([7, 7, 7, 9, 9, 9]) + bytes(6)
    assert sorted(map(tuple, S.load_ppm(spark, f"file://{tmp_path}/i.ppm").collect())) == [(0, 0, 7, 7, 7), (0, 1, 9, 9, 9), (1, 0, 0, 0, 0), (1, 1, 0, 0, 0)]


def small_store(spark, tmp_path, name="store", nlods=1, quality=0.01):
    return store_module.Archive.create(spark, f"file://{tmp_path}/{name}", store_module.Geometry(32, 32, 32, 8, 16, quality, 0, nlods))


def voxels_of(df):
    return {tuple(r) for r in df.select("z", "y", "x", "v").collect()}


def test_residuals_make_a_lossy_store_exact(spark, tmp_path):
    data = np.where(ball(32) > 0, np.random.default_rng(3).integers(1, 255, (32, 32, 32)), 0).astype(np.uint8)
    want = {(*map(int, p), int(data[tuple(p)])) for p in np.argwhere(data)}
    lossy, exact = small_store(spark, tmp_path, "lossy", quality=40.0), small_store(spark, tmp_path, "exact", quality=40.0)
    lossy.append(table_of(spark, data))
    exact.append(table_of(spark, data), exact=True)
    assert voxels_of(lossy.region(0, 0, 0, 32, 32, 32)) != want and voxels_of(exact.region(0, 0, 0, 32, 32, 32)) == want
    row = exact.blocks().selectExpr("sum(octet_length(residual)) r", "sum(octet_length(payload)) p", "count(*) n").first()
    assert 0 < row["r"] < 6 * 512 * row["n"] and exact.verify().count() == 0
    for off in (np.zeros((4, 4, 4), int), np.arange(-32, 32).reshape(4, 4, 4)):
        body = codec.residual_bytes(off)
        assert (body is None) == (not off.any())
        if body is not None:
            assert (codec.add_residual(np.full((4, 4, 4), 100, np.uint8), body) == 100 + off).all()


def test_chained_hash_counts_order_and_contents(spark, tmp_path):
    base = [(0, 0, 0, b"a", 1.0), (0, 0, 1, b"bc", 1.0), (0, 1, 0, None, 1.0)]

    def hash_of(rows, nibbles):
        blocks = spark.createDataFrame([(0, *r) for r in rows], "cz int, bz int, by int, bx int, payload binary, quality double").withColumn("residual", F.lit(None).cast("binary"))
        parts = store_module.block_parts(blocks, ["cz"])
        return parts.withColumn("nibbles", F.create_map(*(F.lit(x) for kv in nibbles.items() for x in kv))).select(store_module.chunk_hash()).first()[0]

    first = hash_of(base, {0: 3})
    assert hash_of(base[::-1], {0: 3}) == first
    swapped = [(0, 0, 0, b"bc", 1.0), (0, 0, 1, b"a", 1.0), base[2]]
    others = [hash_of(swapped, {0: 3}), hash_of(base, {0: 4}), hash_of(base, {1: 3}), hash_of(base[:2], {0: 3}), hash_of([(*base[0][:4], 2.0), *base[1:]], {0: 3}), hash_of([(0, 0, 0, b"ab", 1.0), (0, 0, 1, b"c", 1.0), base[2]], {0: 3})]
    assert len({first, *others}) == 7


def test_pyramid_upkeep_equals_a_rebuild_by_stream(spark, tmp_path):
    """Three batches of changed chunks through a stream; after all, every level is that of a store built at once."""
    rng = np.random.default_rng(5)
    data = np.where(rng.random((32, 32, 32)) < 0.4, rng.integers(1, 255, (32, 32, 32)), 0)
    kept = small_store(spark, tmp_path, "kept", 3)
    now, feed, states = data.copy(), tmp_path / "feed", []
    every = np.argwhere(np.ones_like(data))
    for k, (region, change) in enumerate(((np.s_[:], lambda a: a), (np.s_[:16, :16], lambda a: a // 2), (np.s_[16:, :, 16:], lambda a: a * 0))):
        mask = np.zeros_like(data, bool)
        mask[region] = True
        now[region] = change(now[region])
        rows = [(*map(int, p), int(now[tuple(p)])) for p in every if mask[tuple(p)]]
        spark.createDataFrame(rows, "z int, y int, x int, v int").coalesce(1).write.mode("append").parquet(f"file://{feed}")
        progress = pyramid_stream.Progress(states.append)
        spark.streams.addListener(progress)
        stream = spark.readStream.schema("z int, y int, x int, v int").parquet(f"file://{feed}")
        query = pyramid_stream.keep_up(stream, kept.path, f"file://{tmp_path}/checkpoint")
        assert query.awaitTermination(120)
        whole = small_store(spark, tmp_path, f"whole{k}", 3)
        whole.build(spark.createDataFrame([(*map(int, p), int(now[tuple(p)])) for p in every], "z int, y int, x int, v int"))
        for lod in range(3):
            assert voxels_of(kept.region(0, 0, 0, 32, 32, 32, lod)) == voxels_of(whole.region(0, 0, 0, 32, 32, 32, lod)), (k, lod)
        for _ in range(100):
            if len(states) > k:
                break
            time.sleep(0.1)
        spark.streams.removeListener(progress)
        assert states[k]["changes"] == {"voxels": len(rows), "material": sum(r[3] > 0 for r in rows)}
    # Of eight chunks four are as first appended; the later changes reached two each.
    newest = kept.chunks().where("lod = 0").groupBy("version").count().orderBy("version").collect()
    assert [r["count"] for r in newest] == [4, 2, 2]


def test_observed_counts(spark, tmp_path):
    data = ball(32)
    store = small_store(spark, tmp_path)
    store.append(table_of(spark, data))
    seen = store.observed_decode().first()
    sizes = store.blocks().selectExpr("count(*) n", "sum(octet_length(payload)) b").first()
    assert (seen["blocks"], seen["bytes"], seen["errors"], seen["decoded"], seen["voxels"]) == (sizes["n"], sizes["b"], 0, sizes["n"], (data > 0).sum())


def test_versions_ascend_within_a_process(spark, tmp_path):
    store = small_store(spark, tmp_path)
    got = [store._next_version() for _ in range(1000)]
    assert got == sorted(set(got))


def bytes_read(spark, run):
    """Input bytes of the stages of a job, by Spark's own metrics."""
    sc = spark.sparkContext
    group = f"bytes-{time.time_ns()}"
    sc.setJobGroup(group, group)
    out = run()
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    return out, sum(sc._jsc.sc().statusStore().lastStageAttempt(s).inputBytes() for s in stages)


def test_a_box_reads_only_files_that_hold_its_chunks(spark, tmp_path):
    data = np.random.default_rng(7).integers(1, 255, (32, 32, 32)).astype(np.uint8)
    store = Archive.create(spark, f"file://{tmp_path}/s", Geometry(32, 32, 32, 4, 8, 0.01))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so small a store is one file
    try:
        store.append(table_of(spark, data))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = store.files().count()
    assert files >= 3
    near = store.near(0, 0, 0, 0, 5, 5, 5)
    block_files = lambda df: sum("/blocks/" in f for f in df.inputFiles())
    assert block_files(near) == 1 < block_files(store.near(0, 0, 0, 0, 32, 32, 32)) == files
    _, small = bytes_read(spark, lambda: near.selectExpr("sum(octet_length(payload))").first())
    _, whole = bytes_read(spark, lambda: store.blocks().selectExpr("sum(octet_length(payload))").first())
    assert 0 < small < whole
    assert voxels_of(store.region(3, 2, 1, 4, 5, 6)) == {(z, y, x, int(data[z, y, x])) for z in range(3, 7) for y in range(2, 7) for x in range(1, 7)}
    assert store.region(-9, 0, 0, 5, 5, 5).count() == 0

import math
import os

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxlake.functions.coords import morton
from voxlake.operators import aggregate as A
from voxlake.operators import composite as N
from voxlake.operators import geometry as M
from voxlake.operators import image as I
from voxlake.operators import sample as J
from voxlake.operators import volume as V
from voxlake.plans.registry import QUERIES
from voxlake.sources.volumes import vox, volume_from_function



def ramp(spark, n=16):
    """A linear ramp: trilinear sampling reproduces it exactly."""
    return volume_from_function(spark, n, n, n, F.expr("z + 2 * y + 3 * x"))


def points(spark, rows):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(rows)], "pid int, pz double, py double, px double")


def values(df, key="pid", value="f"):
    return {r[key]: r[value] for r in df.collect()}


def test_trilinear_reproduces_a_ramp(spark):
    at = [(1, 2, 3), (1.5, 2.25, 3.75), (0, 0, 0), (7.125, 3.5, 0.5)]
    got = values(J.sample(points(spark, at), ramp(spark), ["pid"]))
    for k, (z, y, x) in enumerate(at):
        assert math.isclose(got[k], z + 2 * y + 3 * x)


def test_points_outside_or_not_a_number_give_zero(spark):
    at = [(-0.1, 1, 1), (float("nan"), 1, 1), (100, 1, 1)]
    for trilinear in (True, False):
        assert set(values(J.sample(points(spark, at), ramp(spark), ["pid"], trilinear)).values()) == {0.0}


def test_nearest_rounds_half_up(spark):
    assert values(J.sample(points(spark, [(1.5, 2.49, 3)]), ramp(spark), ["pid"], False)) == {0: 2 + 4 + 9}


def test_decimate_is_the_mean_of_material(spark):
    rows = spark.createDataFrame([(0, 0, 0, 10), (0, 0, 1, 13), (0, 1, 0, 0), (2, 2, 2, 0)], "z int, y int, x int, v int")
    assert [tuple(r) for r in A.decimate(rows).collect()] == [(0, 0, 0, 12)]


def test_pyramid_of_a_constant_is_constant(spark):
    levels = A.pyramid(volume_from_function(spark, 16, 16, 16, F.lit(9)), 16, 4)
    assert {(r["lod"], r["v"], r["n"]) for r in levels.groupBy("lod", "v").agg(F.count("*").alias("n")).collect()} == {(0, 9, 4096), (1, 9, 512), (2, 9, 64)}


def test_region_pads_with_air_and_ignores_partitioning(spark):
    v = ramp(spark, 4)
    one, two = V.region(v, -1, 0, 0, 2, 2, 2), V.region(v.repartition(7), -1, 0, 0, 2, 2, 2)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert {r["v"] for r in one.where("z = -1").collect()} == {0}


def test_batched_crops_equal_single_ones(spark):
    v = volume_from_function(spark, 12, 12, 12, F.expr("z + y + x + 1"))
    boxes = spark.createDataFrame([(0, 0, 0, 0), (1, 5, 3, 7)], "box_id int, z0 int, y0 int, x0 int")
    got = V.regions(v, boxes, 4, 4, 4, 4)
    for b, z, y, x in ((0, 0, 0, 0), (1, 5, 3, 7)):
        single = {(r["z"] - z, r["y"] - y, r["x"] - x, r["v"]) for r in V.region(v, z, y, x, 4, 4, 4).collect()}
        assert {(r["z"], r["y"], r["x"], r["v"]) for r in got.where(F.col("box_id") == b).collect()} == single


def test_sampler_is_deterministic():
    assert V.candidate_boxes(7, 4, (64, 64, 64), (8, 8, 8)) == V.candidate_boxes(7, 4, (64, 64, 64), (8, 8, 8))
    assert V.candidate_boxes(0, 1, (9, 9, 9), (9, 9, 9))[0][1:] == (0, 0, 0)
    assert V.candidate_boxes(1, 1, (4, 4, 4), (9, 9, 9)) == []


def test_integrity_scan_finds_a_changed_voxel(spark):
    v = ramp(spark, 8)
    stored = V.voxel_hash(v, 4)
    assert V.corrupt_chunks(v.repartition(5), stored, 4).count() == 0
    changed = v.withColumn("v", F.when(F.expr("z = 5 AND y = 0 AND x = 0"), 99).otherwise(F.col("v")))
    assert [tuple(r) for r in V.corrupt_chunks(changed, stored, 4).collect()] == [(1, 0, 0)]


def test_morton_interleaves(spark):
    row = spark.range(1).select(morton(F.lit(1), F.lit(0), F.lit(1)).alias("a"), morton(F.lit(0), F.lit(3), F.lit(0)).alias("b")).first()
    assert (row["a"], row["b"]) == (0b101, 0b010010)


def test_modes_along_a_ramp(spark):
    pixels = M.plane_points(spark, (8, 8, 8), (1, 0, 0), 4, 4, 1.0)
    v = volume_from_function(spark, 20, 20, 20, F.expr("10 * z"))
    want = {"min": 40, "max": 120, "mean": 80, "none": 80}
    for mode, value in want.items():
        assert {r["val"] for r in N.render(v, pixels, mode, -4, 4).collect()} == {value}
    depth = N.render(v, pixels, "depth", -4, 4, alpha_min=79 / 255)
    assert {r["val"] for r in depth.collect()} == {int(1 + 254 * 4 / 8 + 0.5)}


def test_alpha_stops_at_the_first_opaque_sample(spark):
    pixels = M.plane_points(spark, (8, 8, 8), (1, 0, 0), 2, 2, 1.0)
    v = volume_from_function(spark, 20, 20, 20, F.when(F.col("z") < 6, 0).otherwise(255))
    assert {r["val"] for r in N.render(v, pixels, "alpha", -4, 4).collect()} == {255}


def test_plane_basis_is_orthonormal():
    for normal in ((1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 2, 3), (1, 1, 1)):
        b = np.array(M.plane_basis(normal))
        assert np.allclose(b @ b.T, np.eye(3))


def test_flat_quad_has_unit_normals_and_holes(spark):
    grid = spark.range(64).select(F.expr("CAST(id DIV 8 AS INT)").alias("gy"), (F.col("id") % 8).cast("int").alias("gx"))
    ok = ~((F.col("gy") == 3) & (F.col("gx") == 3))
    grid = grid.select("gy", "gx", F.when(ok, 5.0).alias("pz"), F.when(ok, F.col("gy") * 1.0).alias("py"), F.when(ok, F.col("gx") * 1.0).alias("px"))
    rows = M.quad_points(grid, 8, 8, 0.0, 0.0, 0.5, 15, 15).collect()
    for r in rows:
        near = 2 < r["i"] / 2 < 4 and 2 < r["j"] / 2 < 4
        if near:
            assert r["pz"] is None
        elif r["pz"] is not None:
            assert (r["pz"], r["py"], r["px"]) == (5.0, r["i"] / 2, r["j"] / 2) and abs(r["nz"]) == 1.0


def test_colormaps():
    assert I.colormap_id("magma") == 2 and I.colormap_id("nothing") == 0 and I.colormap_id(None) == 0
    table = I.lut(0, 255, 0)
    assert table[0] == 0xFF000000 and table[128] == 0xFF808080 and table[255] == 0xFFFFFFFF
    assert all(len(set(I.lut(0, 255, k))) > 200 for k in range(9))


def test_valley_between_two_peaks(spark):
    def found(counts):
        return A.valley(spark.createDataFrame(list(counts.items()), "bin int, n long")).withColumn("cut", A.cut_level("valley")).first()

    counts = {i: int(1000 * math.exp(-(((i - 60) / 12) ** 2)) + 800 * math.exp(-(((i - 160) / 15) ** 2))) for i in range(256)}
    dark, light, low, depth, cut = found(counts)
    assert (dark, light) == (60, 160) and 90 < low < 130 and depth > 0.9 and cut == low
    assert tuple(found({5: 10})) == (None, None, None, None, 39)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=200))
def test_percentile_rank_is_by_index(values_):
    s = sorted(values_)
    assert s[int(50 / 100 * (len(s) - 1))] in values_


def test_crops_cover_every_order(spark, small):
    cube = np.zeros((64, 64, 64), int)
    for r in vox(spark, small, 64).collect():
        cube[r["z"], r["y"], r["x"]] = r["v"]
    want = []
    for k, c in spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_custkey").collect():
        z, y, x = k * 7 % 56, c * 5 % 56, k * 3 % 56
        box = cube[z : z + 8, y : y + 8, x : x + 8]
        want += [(k, *map(int, at), int(box[tuple(at)])) for at in np.argwhere(box > 0)]
    got = QUERIES["c8_batched_crops"](spark, small).select("box_id", "z", "y", "x", "v")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(k % 10 for k, *_ in want)


def test_scratch_tables_are_the_sessions_own_and_can_be_dropped(spark):
    from voxlake.functions.scratch import clear, materialize, session_dir

    other = spark.newSession()
    table = materialize(other.range(5).toDF("k"), "probe")
    at = session_dir(spark).removeprefix("file://")
    assert table.count() == 5 and any(n.startswith("probe-") for n in os.listdir(at))
    clear(spark)
    assert not os.path.exists(at)


def test_ranks_over_ranges_are_those_of_one_window(spark):
    from voxlake.functions.order import ranked, running

    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 5).alias("v")).repartition(7)
    got = {r["k"]: (r["at"], r["sum"]) for r in ranked(running(rows, [F.desc("k")], F.col("v"), "sum"), [F.desc("k")], "at").collect()}
    total, want = 0, {}
    for at, r in enumerate(sorted(rows.collect(), key=lambda r: -r["k"]), 1):
        total += r["v"]
        want[r["k"]] = (at, total)
    assert got == want


def test_trilinear_points_meet_a_cell_once_and_invalid_ones_are_spread(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 256, (5, 5, 5))
    v = spark.createDataFrame([(*map(int, p), int(a[tuple(p)])) for p in np.argwhere(a > -1)], "z int, y int, x int, v int")
    at = [(k, *map(float, rng.uniform(-1, 5, 3))) for k in range(300)] + [(300, float("nan"), 1.0, 1.0), (301, 2.0, 3.0, 4.0)]
    points = spark.createDataFrame(at, "pid long, pz double, py double, px double")
    found = J.sample(points, v, ["pid"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan.split("Join")[1].split("Aggregate")[0] and plan.index("Join") < plan.index("Aggregate")
    wide = np.pad(a, ((0, 2),) * 3)
    for r in found.collect():
        p = np.array(at[r["pid"]][1:])
        want = 0.0
        if (p >= 0).all():
            low = np.floor(p).astype(int)
            for d in np.ndindex(2, 2, 2):
                want += np.prod(np.where(d, p - low, 1 - (p - low))) * wide[tuple(low + d)]
        assert abs(r["f"] - want) < 1e-9


def test_crops_are_unrolled_without_a_row_through_python(spark):
    v = spark.createDataFrame([(0, 0, 0, 200), (3, 3, 3, 255)], "z int, y int, x int, v int")
    boxes = spark.range(9).select(F.col("id").alias("box_id"), *(F.lit(0).alias(c) for c in ("z0", "y0", "x0")))
    got = V.regions(v, boxes, 4, 4, 4, 4)
    assert got._jdf.queryExecution().optimizedPlan().toString().index("Generate") < got._jdf.queryExecution().optimizedPlan().toString().index("MapInArrow")
    assert {(r["z"], r["v"]) for r in got.collect()} == {(0, 200), (3, 255)} and got.count() == 18

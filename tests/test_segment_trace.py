import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import segment as P
from voxlake.operators import shaded as R
from voxlake.operators import trace as T
from voxlake.operators.graph import connected_components
from voxlake.sources.volumes import volume_from_function


def mask_of(spark, a):
    return spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(a)], "z int, y int, x int")


def array_of(df, shape, value=None):
    out = np.zeros(shape, float if value else bool)
    for r in df.collect():
        out[r["z"], r["y"], r["x"]] = r[value] if value else True
    return out


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(3)
    pairs = [tuple(map(int, p)) for p in rng.integers(0, 60, (50, 2))]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for a, b in pairs if a != b for y in (a, b)}}


def test_a_long_chain_is_one_component(spark):
    links = spark.range(120).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in connected_components(links).collect()} == {0}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_labels_and_small_components(spark):
    a = np.zeros((8, 8, 8), bool)
    a[1, 1, 1] = a[2, 2, 2] = a[6, 6, 6] = True
    rows = {(r["z"], r["y"], r["x"]): r["label"] for r in P.label(mask_of(spark, a), 8, 8).collect()}
    assert rows == {(1, 1, 1): 1, (2, 2, 2): 1, (6, 6, 6): 2}
    assert P.remove_small(mask_of(spark, a), 8, 8, 2).count() == 2


def test_hollow_box_is_filled_and_an_open_one_is_not(spark):
    a = np.zeros((10, 10, 10), bool)
    a[2:8, 2:8, 2:8] = True
    a[3:7, 3:7, 3:7] = False
    assert P.fill_cavities(mask_of(spark, a), (10, 10, 10)).count() == 6**3
    a[2, 4, 4] = False
    assert P.fill_cavities(mask_of(spark, a), (10, 10, 10)).count() == a.sum()


def test_a_hole_is_plugged_both_ways(spark):
    a = np.zeros((4, 8, 8), bool)
    a[1:3, 1:7, 1:7] = True
    a[1, 3, 3] = False
    want = a.copy()
    want[1, 3, 3] = True
    assert (array_of(P.plug_holes(mask_of(spark, a), a.shape), a.shape) == want).all()
    assert (P.plug_holes_raster(a)[0] == want).all() and P.plug_holes_raster(a)[1] == 1


def test_closing_fills_a_notch(spark):
    a = np.zeros((12, 12, 12), bool)
    a[3:9, 3:9, 3:9] = True
    a[5, 5, 5] = False
    closed = array_of(P.close(mask_of(spark, a), 1, a.shape), a.shape)
    assert closed[5, 5, 5] and closed.sum() == 6**3


def test_distance_is_exact(spark):
    a = np.random.default_rng(1).random((7, 6, 5)) < 0.06
    a[3, 3, 3] = True
    at = np.argwhere(a)
    want = np.array([[[min(np.sqrt(((at - (z, y, x)) ** 2).sum(1))) for x in range(5)] for y in range(6)] for z in range(7)])
    assert np.abs(array_of(P.distance(mask_of(spark, a), a.shape), a.shape, "d") - want).max() < 1e-9


def test_signed_distance_of_a_slab(spark):
    a = np.zeros((12, 4, 4), bool)
    a[5:8] = True
    got = array_of(P.signed_distance(mask_of(spark, a), a.shape), a.shape, "d")
    assert got[:, 0, 0].tolist() == [5, 4, 3, 2, 1, -1, -2, -1, 1, 2, 3, 4]


@pytest.mark.parametrize("tile", [8, 64])
def test_a_flat_sheet_is_detected_whatever_the_tiles(spark, tile):
    sheet = volume_from_function(spark, 24, 24, 24, F.when(F.col("z").between(11, 12), 220).otherwise(40))
    found = array_of(P.detect_sheets(sheet, (24, 24, 24), value_low=80, tile=tile), (24, 24, 24))
    assert found[11:13].all() and found.sum() == 2 * 24 * 24


def test_blur_keeps_a_constant(spark):
    field = volume_from_function(spark, 6, 6, 6, F.lit(50)).withColumn("f", F.col("v").cast("double"))
    assert all(abs(r["f"] - 50) < 1e-9 for r in P.gaussian_blur(field, 1.0, ["f"]).collect())


# ---------------------------------------------------------------- least squares and tracing


def test_settled_points_and_an_outlier():
    rng = np.random.default_rng(2)
    truth = rng.normal(0, 20, (50, 3))
    ways = np.concatenate([np.eye(3), [[-0.6, -0.8, 0], [1, 0, 0]]]) + rng.normal(0, 0.1, (50, 5, 3))
    anchors = truth[:, None] + 7 * ways / np.linalg.norm(ways, axis=2, keepdims=True)
    anchors[:, 4] += np.where(np.arange(50) % 2, 30.0, np.nan)[:, None]
    p = T.settle(truth + rng.normal(0, 0.5, (50, 3)), anchors, 7.0, cauchy=0.05)
    assert np.abs(p - truth).max() < 0.05
    # The result is a minimum: no small step lowers the sum of squares that was asked for.
    start = truth + 1.0
    p = T.settle(start, anchors[:, :3], 7.0, start, 0.3)

    def cost(q):
        d = np.linalg.norm(q[:, None] - anchors[:, :3], axis=2)
        return (np.where(d >= 7, d / 7 - 1, 7 / d - 1) ** 2).sum(1) + ((q - start) ** 2).sum(1) * 0.3**2 / 49

    for k in range(3):
        for sign in (-1, 1):
            assert (cost(p) <= cost(p + sign * 0.01 * np.eye(3)[k]) + 1e-9).all()


def test_a_field_is_sampled_and_its_zero_set_found(spark):
    field = volume_from_function(spark, 24, 24, 24, F.lit(0)).select("z", "y", "x", F.sqrt(F.pow(F.col("x") - 11.5, 2) + F.pow(F.col("z") - 11.5, 2)).alias("d")).withColumn("d", F.col("d") - 8)
    points = spark.createDataFrame([(1, 18.0, 5.5, 12.0), (2, 11.5, 3.0, 4.5), (3, 30.0, 0.0, 0.0)], "gid long, x double, y double, z double")
    seen = {r["gid"]: r for r in T.field_at(points, field, (24, 24, 24), ["gid"]).collect()}
    assert abs(seen[1]["f"] - (np.hypot(6.5, 0.5) - 8)) < 0.1 and seen[1]["g"]["x"] > 0.9 and seen[3]["f"] == 0 and seen[3]["g"]["y"] == 0
    found = {r["gid"]: r for r in T.to_zero(points, field, (24, 24, 24), ["gid"]).collect()}
    assert set(found) == {1, 2} and all(abs(np.hypot(r["x"] - 11.5, r["z"] - 11.5) - 8) < 0.05 for r in found.values())
    patch = T.seed_patches(points.where("gid < 3"), field, (24, 24, 24), 2.0).collect()
    assert len(patch) == 18 and all(abs(np.hypot(r["x"] - 11.5, r["z"] - 11.5) - 8) < 0.05 for r in patch)


def cells_of(spark, points):
    return spark.createDataFrame([(g, r, c, *map(float, p)) for (g, r, c), p in points.items()], "gid long, r int, c int, x double, y double, z double")


def test_planes_grow_exactly_whatever_their_seed(spark):
    flat = {0: lambda r, c: (10.0 * c, 10.0 * r, 0.0), 1: lambda r, c: (6.0 * c, 8.0 * c, 10.0 * r)}
    seed = {(0, r, c): flat[0](r, c) for r in range(2, 4) for c in range(2, 4)} | {(1, r, c): flat[1](r, c) for r in range(0, 2) for c in range(5, 7)}
    got = {(x["gid"], x["r"], x["c"]): (x["x"], x["y"], x["z"]) for x in T.grow(cells_of(spark, seed), 6, 7, 10.0).collect()}
    assert set(got) == {(g, r, c) for g in (0, 1) for r in range(6) for c in range(7)}
    assert max(np.abs(np.subtract(p, flat[g](r, c))).max() for (g, r, c), p in got.items()) < 1e-6


def test_cells_with_a_wrong_spacing_are_not_accepted(spark):
    """The sheet is torn: beyond its edge predictions fall on top of each other."""
    seed = {(0, r, c): (10.0 * c, 10.0 * r, 0.0) for r in range(2) for c in range(2)} | {(0, r, 2): (40.0, 10.0 * r, 0.0) for r in range(2)}
    strict = T.grow(cells_of(spark, seed), 2, 4, 10.0, T.Growth(accept=0.05, straight=50.0))
    assert strict.count() == 6
    loose = T.grow(cells_of(spark, seed), 2, 4, 10.0, T.Growth(accept=0, straight=50.0))
    assert loose.count() == 8


def test_a_field_halves_the_error_on_a_cylinder(spark):
    """A patch of a cylinder grown with and without the field."""
    size, radius, unit, n = 40, 14.0, 3.0, 7
    field = volume_from_function(spark, size, size, size, F.lit(0)).select("z", "y", "x", (F.sqrt(F.pow(F.col("x") - 19.5, 2) + F.pow(F.col("z") - 19.5, 2)) - radius).alias("d"))
    turn = lambda c: (c - 3) * unit / radius
    seed = {(0, r, c): (19.5 + radius * np.cos(turn(c)), 19.5 + (r - 3) * unit, 19.5 + radius * np.sin(turn(c))) for r in range(2, 5) for c in range(2, 5)}

    def error(options, sdf):
        rows = T.grow(cells_of(spark, seed), n, n, unit, options, sdf, (size,) * 3).collect()
        assert len(rows) == n * n
        return np.mean([abs(np.hypot(r["x"] - 19.5, r["z"] - 19.5) - radius) for r in rows])

    alone, held = error(T.Growth(accept=0), None), error(T.Growth(accept=0), field)
    assert held < 0.5 * alone and held < 0.3


# ---------------------------------------------------------------- shading


def test_air_is_black_and_sheets_are_lit(spark):
    a = np.zeros((24, 8, 8))
    a[10:13] = 200
    volume = R.Dense(a)
    points, normals = np.array([[11.0, 4, 4], [2.0, 4, 4]]), np.tile([1.0, 0, 0], (2, 1))
    for s in (R.Shading(), R.Shading(shadow=0.5, glow=0.4, curvature=0.3), R.Shading(ink=True), R.Shading(ink=True, lock=2.0)):
        lit, dark = R.shade(volume, points, normals, s)
        assert lit > 20 and dark == 0


def test_shadows_darken():
    a = np.zeros((40, 40, 40))
    a[20:23] = 200
    a[5:15, :, 24:30] = 255
    p, n = np.array([[20.0, 20, 20]]), np.array([[1.0, 0, 0]])
    open_, shadowed = (R.shade(R.Dense(a), p, n, R.Shading(light=(-1, 0, 0.6), shadow=s))[0] for s in (0.0, 1.0))
    assert shadowed <= open_


def test_frames_are_orthonormal():
    light = np.random.default_rng(1).normal(size=(300, 3))
    light[:6] = np.concatenate([np.eye(3), -np.eye(3)])
    light /= np.linalg.norm(light, axis=1, keepdims=True)
    frame = np.stack([light, *R.across(light)], 1)
    assert np.abs(np.einsum("nac,nbc->nab", frame, frame) - np.eye(3)).max() < 1e-12


def sheets_by_hand(row, at, steps):
    runs, k = [], 0
    while k < len(row):
        e = k
        while e < len(row) and row[e] >= 0.35:
            e += 1
        if e - k >= 2:
            runs.append((abs((k + e - 1) // 2 - at), k))
        k = max(e, k + 1)
    if not runs:
        return 0, 0
    k = min(runs)[1]
    return max(k - 1, 0), min(k + steps, len(row))


def test_sheet_ranges():
    rng = np.random.default_rng(3)
    density = rng.random((400, 13)) * rng.choice([0.3, 0.5, 1.0], (400, 1))
    density[0], density[1] = 1.0, 0.0
    first, stop = R.sheet_range(density, 5, 3)
    assert [(int(a), int(b)) for a, b in zip(first, stop, strict=True)] == [sheets_by_hand(r.tolist(), 5, 3) for r in density]


def pixel_by_hand(v, p, n, s, tangent=None):
    """A pixel by the definition, one scalar after the other."""

    def at(q):
        if min(q) < 0 or any(c > m - 1 for c, m in zip(q, v.shape, strict=True)):
            lo = [int(np.floor(c)) for c in q]
            if min(q) < 0 or any(k > m - 1 for k, m in zip(lo, v.shape, strict=True)):
                return 0.0
        lo = [int(np.floor(c)) for c in q]
        total = 0.0
        for dz, dy, dx in itertools.product((0, 1), repeat=3):
            k = (lo[0] + dz, lo[1] + dy, lo[2] + dx)
            w = np.prod([(c - a) if d else 1 - (c - a) for c, a, d in zip(q, lo, (dz, dy, dx), strict=True)])
            if all(0 <= a < m for a, m in zip(k, v.shape, strict=True)):
                total += w * v[k]
        return total

    light = -n
    if any(s.light):
        light = np.array(s.light, float) / np.linalg.norm(s.light)
        if s.surface_light and tangent is not None:
            t = tangent - (tangent @ n) * n
            if np.linalg.norm(t) > 1e-6:
                t = t / np.linalg.norm(t)
                light = -light[0] * n + light[1] * -np.cross(n, t) + light[2] * t
    half = light - n
    half = half / np.linalg.norm(half) if np.linalg.norm(half) > 1e-6 else half
    rays = R.glow_rays(light[None])[0] if s.ink else light[None]
    glow = s.glow if s.glow > 0 else (0.5 if s.ink else 0.0)
    steps = int(np.floor((s.t1 - s.t0) / s.dt + 1e-9)) + 1
    where = [p + (s.t0 + s.dt * k) * n for k in range(steps)]
    density = [min(max((at(q) / 255 - s.alpha_min) * s.opacity / (1 - s.alpha_min), 0), 1) for q in where]
    first, stop = sheets_by_hand(density, round(-s.t0 / s.dt), max(round(s.lock / s.dt), 1)) if s.ink and s.lock else (0, steps)
    light_sum, through = 0.0, 1.0
    for k in range(first, stop):
        if density[k] <= 0 or through < 0.02:
            continue
        q, value = where[k], at(where[k])
        opacity = 1 - np.exp(-s.absorption * np.floor(density[k] * 255 + 0.5) / 255 * s.dt)
        taps = [(at(q + e), at(q - e)) for e in np.eye(3)]
        g = np.array([a - b for a, b in taps])
        g2 = (g @ g) / 4
        w = g2 / (g2 + s.knee**2)
        unit = g / np.linalg.norm(g) if g2 > 1e-8 else np.zeros(3)
        spec = abs(unit @ half) ** s.shininess if g2 > 1e-8 else 0.0
        lit, reach = s.ambient + (1 - w) * s.diffuse, 1.0
        if (s.shadow or glow) and w > 0.05:
            tau = [min(sum(min(max((at(q + 2.0 * j * r) / 255 - s.alpha_min) * s.opacity / (1 - s.alpha_min), 0), 1) * s.absorption * 2.0 for j in range(1, 13)), 6.0) for r in rays]
            reach = np.mean([np.exp(-t) for t in tau])
            lit += glow * w * np.mean([np.exp(-0.3 * t) for t in tau])
        shade = 1 - s.shadow + s.shadow * reach
        lit += w * s.diffuse * abs(unit @ light) * shade
        if s.curvature:
            lit = max(lit + s.curvature * min(max(-(sum(map(sum, taps)) - 6 * value) / 510, -1), 1) * w, 0)
        light_sum += through * opacity * (value * lit + 255 * s.specular * spec * shade * w)
        through *= 1 - opacity
    if s.ink:
        light_sum = light_sum + through * s.transmission * 255 * (1 - through) if stop > first else 0.0
    return int(np.floor(min(max(light_sum, 0), 255) + 0.5))


LOOKS = {
    "plain": R.Shading(),
    "shadow": R.Shading(light=(-1, -1, 0.5), shadow=0.6, glow=0.3, curvature=0.4, alpha_min=0.1),
    "ink": R.Shading(ink=True, absorption=0.3),
    "locked": R.Shading(ink=True, lock=3.0, absorption=0.3, t0=-5.0, t1=6.0),
    "surface": R.Shading(light=(0.3, 0.2, 1), surface_light=True),
}


@pytest.mark.parametrize("look", sorted(LOOKS))
def test_every_pixel_by_the_definition(spark, look):
    """Three shading modes over a small volume, pixel by pixel: the query's way, by tiles and bricks, against scalars."""
    rng = np.random.default_rng(11)
    v = np.where(rng.random((24, 20, 22)) < 0.3, rng.integers(30, 255, (24, 20, 22)), 0)
    v[9:12] = rng.integers(120, 255, (3, 20, 22))
    s = LOOKS[look]
    voxels = spark.createDataFrame([(*map(int, q), int(v[tuple(q)])) for q in np.argwhere(v)], "z int, y int, x int, v int")
    lean = np.array([0.9, 0.3, -0.2])
    rows = [(i, j, 10.0 + 0.3 * i, 5.0 + 1.1 * i, 6.0 + 1.3 * j, *map(float, lean)) for i in range(6) for j in range(7)] + [(6, 0, None, None, None, 1.0, 0.0, 0.0)]
    pixels = spark.createDataFrame(rows, "i int, j int, pz double, py double, px double, nz double, ny double, nx double")
    got = {(r["i"], r["j"]): r["val"] for r in R.render_shaded(voxels, pixels, s, tile=8, brick=8).collect()}
    n = lean / np.linalg.norm(lean)
    seen = set()
    for i, j, *rest in rows[:-1]:
        want = pixel_by_hand(v, np.array(rest[:3]), n, s, np.array([0, 0, 1.3]) if s.surface_light else None)
        assert abs(got[i, j] - want) <= 1, (look, i, j, got[i, j], want)
        seen.add(want)
    assert got[6, 0] == 0 and len(seen) > 15


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_field_join_never_takes_points_for_a_small_table(spark):
    points = spark.range(10).select(F.col("id").alias("gid"), *((F.col("id") % 3 + 1.5).alias(a) for a in "xyz"))
    field = spark.range(8).selectExpr("CAST(id DIV 4 AS INT) AS z", "CAST(id DIV 2 % 2 AS INT) AS y", "CAST(id % 2 AS INT) AS x", "CAST(id AS DOUBLE) AS d")
    seen = T.field_at(points, field, (2, 2, 2), ["gid"])
    assert "Broadcast" not in plan_of(seen)
    assert {(r["f"], r["g"]["x"]) for r in seen.collect()} == {(0.0, 0.0)}
    inside = points.withColumns({"x": F.col("gid") / 16, "y": F.lit(1.0) - F.col("gid") / 16, "z": F.col("gid") / 32})
    assert {(r["gid"], r["f"], tuple(r["g"])) for r in T.field_at(inside, field, (2, 2, 2), ["gid"]).collect()} == {(k, k / 16 + 2 - k / 8 + k / 8, (1.0, 2.0, 4.0)) for k in range(10)}


def test_grids_that_fit_grow_after_one_shuffle_like_waves(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(g, r, c, 10.0 * c + rng.normal(0, 0.8), 10.0 * r + rng.normal(0, 0.8), rng.normal(0, 0.8)) for g in range(40) for r in range(2, 5) for c in range(2, 4) if rng.random() < 0.9]
    rows += [(7, 30, 1, 1.0, 2.0, 3.0), (100, 1, 1, 0.0, 0.0, 0.0)]
    cells = spark.createDataFrame(rows, "gid long, r int, c int, x double, y double, z double")
    for options in (T.Growth(), T.Growth(accept=0.2), T.Growth(accept=0), T.Growth(waves=2)):
        whole = T.grow(cells, 8, 6, 10.0, options)
        assert plan_of(whole).count("Exchange hashpartitioning") == 1
        monkeypatch.setattr(T, "WHOLE", 0)
        waves = T.grow(cells, 8, 6, 10.0, options)
        monkeypatch.undo()
        a, b = ({tuple(r)[:3]: tuple(r)[3:] for r in d.collect()} for d in (whole, waves))
        assert a.keys() == b.keys() and len(a) > len(rows)
        assert max(abs(p - q) for k in a for p, q in zip(a[k], b[k], strict=True)) < 1e-4


def test_the_field_is_evaluated_once_a_point(spark, monkeypatch):
    """A step's or wave's expressions don't repeat the eight corners wherever value or gradient are named."""
    rng = np.random.default_rng(8)
    field = volume_from_function(spark, 24, 24, 24, F.lit(0)).select("z", "y", "x", (F.sqrt(F.pow(F.col("x") - 11.5, 2) + F.pow(F.col("z") - 11.5, 2)) - 8).alias("d"))
    starts = spark.createDataFrame([(g, 18.0 + rng.random(), 9.0 + rng.random(), 12.0 + rng.random()) for g in range(30)], "gid long, x double, y double, z double")
    plans, keep = [], T.materialize
    monkeypatch.setattr(T, "materialize", lambda df, name: (plans.append((name, plan_of(df))), keep(df, name))[1])
    seeds = T.seed_patches(starts, field, (24, 24, 24), 2.0, 3, (1, 1))
    whole = T.grow(seeds, 5, 6, 2.0, T.Growth(), field, (24, 24, 24))
    steps = [plan for name, plan in plans if name in ("newton", "accepted")]
    assert len(steps) > 3 and not any("isnotnull(d7" in plan or "Window" in plan for plan in steps)
    monkeypatch.setattr(T, "WHOLE", 0)
    waves = T.grow(seeds, 5, 6, 2.0, T.Growth(), field, (24, 24, 24))
    a, b = ({tuple(r)[:3]: tuple(r)[3:] for r in d.collect()} for d in (whole, waves))
    assert a.keys() == b.keys() and len(a) > 30 * 15
    assert max(abs(p - q) for k in a for p, q in zip(a[k], b[k], strict=True)) < 1e-4

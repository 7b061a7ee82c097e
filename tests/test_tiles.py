"""Components, cavities, distances and crops by tiles, against the definitions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import components as K
from voxlake.operators import distances as X
from voxlake.operators import volume as V


def mask_of(spark, a):
    return spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(a)], "z int, y int, x int")


def flood(a, offsets):
    """Component of each set voxel: the least linear number it reaches."""
    out = np.full(a.shape, -1)
    for at in map(tuple, np.argwhere(a)):
        if out[at] >= 0:
            continue
        name, todo = np.ravel_multi_index(at, a.shape), [at]
        out[at] = name
        while todo:
            p = todo.pop()
            for d in offsets:
                q = tuple(np.add(p, d))
                if all(0 <= c < n for c, n in zip(q, a.shape, strict=True)) and a[q] and out[q] < 0:
                    out[q] = name
                    todo.append(q)
    return out


ALL26 = [d for d in itertools.product((-1, 0, 1), repeat=3) if any(d)]
ALL6 = [d for d in ALL26 if sum(map(abs, d)) == 1]


@pytest.mark.parametrize("share", [0.08, 0.3])
def test_labels_across_tiles(spark, share):
    a = np.random.default_rng(int(share * 100)).random((11, 9, 14)) < share
    want = flood(a, ALL26)
    roots = {r: k for k, r in enumerate(sorted(set(want[a].tolist())), 1)}
    for tile in (4, 16):
        rows = K.label(mask_of(spark, a), 9, 14, tile).collect()
        assert len(rows) == a.sum()
        assert all(r["root"] == want[r["z"], r["y"], r["x"]] and r["label"] == roots[r["root"]] for r in rows)
        sizes = {r["label"]: r["size"] for r in K.component_sizes(mask_of(spark, a), 9, 14, tile).collect()}
        assert sizes == {k: int((want == r).sum()) for r, k in roots.items()}
    kept = {tuple(r) for r in K.remove_small(mask_of(spark, a), 9, 14, 3, 4).collect()}
    assert kept == {tuple(map(int, p)) for p in np.argwhere(a) if (want == want[tuple(p)]).sum() >= 3}


def test_corners_and_edges_of_tiles_link(spark):
    a = np.zeros((8, 8, 8), bool)
    a[3, 3, 3] = a[4, 4, 4] = True  # by a corner
    a[3, 4, 0] = a[4, 3, 0] = True  # by an edge, falling
    a[0, 0, 7] = True
    assert {r["size"] for r in K.component_sizes(mask_of(spark, a), 8, 8, 4).collect()} == {1, 2}
    assert K.label(mask_of(spark, a).limit(0), 8, 8, 4).count() == 0


def test_links_grow_with_faces(spark):
    """A solid block of 16 tiles of 512 voxels each: a link per meeting of tiles, none per voxel."""
    a = np.ones((8, 8, 32), bool)
    tiles = K.mask_tiles(mask_of(spark, a), 8, 32, 8)
    assert K.links_of(tiles, 8, True).count() == 3 and tiles.count() == 4
    assert K.label(mask_of(spark, a), 8, 32, 8).select("root").distinct().count() == 1


def test_cavities_across_tiles(spark):
    a = np.random.default_rng(5).random((10, 13, 7)) < 0.55
    air = flood(~a, ALL6)
    border = set(np.concatenate([air[s].ravel() for s in ((0,), (-1,), (slice(None), 0), (slice(None), -1), (..., 0), (..., -1))]).tolist())
    want = a | ((air >= 0) & ~np.isin(air, sorted(border)))
    assert want.sum() > a.sum()
    got = [tuple(r) for r in K.fill_cavities(mask_of(spark, a), a.shape, 4).collect()]
    assert sorted(got) == [tuple(map(int, p)) for p in np.argwhere(want)]


def test_a_large_cavity_without_voxels_in_its_tiles(spark):
    a = np.zeros((20, 20, 20), bool)
    a[1:19, 1:19, 1:19] = True
    a[2:18, 2:18, 2:18] = False
    assert K.fill_cavities(mask_of(spark, a), a.shape, 4).count() == 18**3
    a[1, 9, 9] = False
    assert K.fill_cavities(mask_of(spark, a), a.shape, 4).count() == a.sum()


def nearest(a):
    at = np.argwhere(a)
    grid = np.stack(np.meshgrid(*map(np.arange, a.shape), indexing="ij"), -1)
    return ((grid[..., None, :] - at) ** 2).sum(-1).min(-1)


@pytest.mark.parametrize("share,tile", [(0.02, 4), (0.3, 4), (0.004, 8), (0.02, 32)])
def test_distances_across_tiles(spark, share, tile):
    a = np.random.default_rng(int(share * 1000)).random((13, 10, 17)) < share
    a[5, 5, 5] = True
    want = nearest(a)
    rows = X.squared_distance(mask_of(spark, a), a.shape, tile).collect()
    assert len(rows) == a.size and all(r["d2"] == want[r["z"], r["y"], r["x"]] for r in rows)
    inner = nearest(~a)
    for r in X.signed_distance(mask_of(spark, a), a.shape, tile).collect():
        at = r["z"], r["y"], r["x"]
        assert r["d"] == (np.sqrt(want[at]) if want[at] else -np.sqrt(inner[at]))


def test_a_line_of_512_and_no_mask(spark):
    a = np.zeros((1, 2, 512), bool)
    a[0, 0, [3, 200, 207, 511]] = True
    want = nearest(a)
    for r in X.squared_distance(mask_of(spark, a), a.shape, 16).collect():
        assert r["d2"] == want[r["z"], r["y"], r["x"]]
    none = X.squared_distance(mask_of(spark, a).limit(0), (2, 3, 40), 16)
    assert {r["d2"] for r in none.collect()} == {X.FAR} and none.count() == 240


def test_lists_of_parabolas():
    """What a segment sends and whom it sends it to suffices for any heights."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        f = np.where(rng.random((6, 48)) < rng.choice([0.05, 0.5, 1.0]), rng.integers(0, rng.choice([3, 60, 2500]), (6, 48)).astype(float), X.FAR)
        want = np.minimum((f[:, None, :] + (np.arange(48)[:, None] - np.arange(48)) ** 2).min(2), X.FAR)
        parts = [f[:, k : k + 8] for k in range(0, 48, 8)]
        own = [X.lower_envelope(p) for p in parts]
        low = np.stack([p.min(1) for p in parts])
        at = np.stack([8 * k + p.argmin(1) for k, p in enumerate(parts)])
        top = np.stack([o.max(1) for o in own])
        pairs = X.relevant(low, at, top, 8)
        sent = 0
        for k in range(6):
            lists = [X.beyond(parts[j], 8 * j) if j < k else X.before(parts[j], 8 * j) for s, j in pairs if s == k]
            sent += sum(map(len, lists))
            assert (np.minimum(X.merged(own[k], lists, 8 * k), X.FAR) == want[:, 8 * k : 8 * k + 8]).all()
        if (f == 0).all():
            assert sent == 0


def test_crops_on_packed_blocks(spark):
    rng = np.random.default_rng(8)
    a = rng.integers(0, 4, (20, 20, 20))
    v = spark.createDataFrame([(*map(int, p), int(a[tuple(p)])) for p in np.argwhere(a > -1)], "z int, y int, x int, v int")
    boxes = [(k, *map(int, rng.integers(-3, 19, 3))) for k in range(30)] + [(7, 2, 2, 2), (7, 2, 2, 2), (99, 50, 0, 0)]
    got = sorted(tuple(r) for r in V.regions(v, spark.createDataFrame(boxes, "box_id long, z0 int, y0 int, x0 int"), 6, 3, 9, 4).collect())
    want = []
    for b, *lo in boxes:
        for p in itertools.product(range(6), range(3), range(9)):
            q = tuple(np.add(lo, p))
            if all(0 <= c < 20 for c in q) and a[q]:
                want.append((b, *p, int(a[q])))
    assert got == sorted(want)


def test_a_block_that_all_boxes_meet(spark):
    v = spark.createDataFrame([(0, 0, 0, 9), (3, 3, 3, 5)], "z int, y int, x int, v int")
    boxes = spark.range(5000).select(F.col("id").alias("box_id"), *(F.lit(0).alias(c) for c in ("z0", "y0", "x0")))
    got = V.regions(v, boxes, 2, 2, 2, 4)
    assert got.count() == 5000 and got.where("v = 9 AND z = 0 AND y = 0 AND x = 0").count() == 5000


def test_a_crop_is_one_row_until_it_is_unrolled(spark, monkeypatch):
    """Crops are neither copied to all blocks that they touch nor gathered; a block where many start is dealt over tasks."""
    monkeypatch.setattr(V, "UNROLLED", 64 * 50, raising=False)
    rng = np.random.default_rng(9)
    a = rng.integers(0, 3, (16, 16, 16)) * 120
    v = spark.createDataFrame([(*map(int, p), int(a[tuple(p)])) for p in np.argwhere(a > 0)], "z int, y int, x int, v int")
    at = np.concatenate([rng.integers(0, 4, (900, 3)), rng.integers(-4, 16, (300, 3))])
    boxes = spark.createDataFrame([(k, *map(int, p)) for k, p in enumerate(at)], "box_id long, z0 int, y0 int, x0 int")
    got = V.regions(v, boxes, 4, 4, 4, 4)

    def nodes(plan):
        yield plan
        for k in range(plan.children().size()):
            yield from nodes(plan.children().apply(k))

    met = next(n for n in nodes(got._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join")
    assert not {"Generate", "Aggregate"} & {n.nodeName() for n in nodes(met.children().apply(0))}
    wide = np.zeros((24, 24, 24), int)
    wide[4:20, 4:20, 4:20] = a
    want = [(k, *map(int, p), int(box[tuple(p)])) for k, q in enumerate(at) for box in (wide[tuple(slice(c + 4, c + 8) for c in q)],) for p in np.argwhere(box)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    tasks = got.groupBy(F.spark_partition_id()).agg(F.count_distinct("box_id").alias("n")).agg(F.max("n")).first()[0]
    assert tasks < 450

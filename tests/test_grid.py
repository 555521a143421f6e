import itertools

import numpy as np
import pytest
from volumes import components, dense, dims, frame, gaussian, grow, largest, offsets, points, shrink

from volspark.operators import cleanup, components as C, grid as G, partial_volume as P
from volspark.operators.nearest import nearest_points, split_points

RNG = np.random.default_rng(3)
SHAPE = (6, 7, 8)


@pytest.mark.parametrize("connectivity,limit,steps", [(6, 1, 2), (18, 2, 1), (26, 3, 2)])
def test_dilate_and_erode_match_brute_force(spark, connectivity, limit, steps):
    a = RNG.random(SHAPE) < 0.12
    mask = frame(spark, {"m": a.astype(int)}).filter("m = 1")
    assert points(G.dilate(mask, dims(spark, SHAPE), connectivity, steps)) == set(zip(*np.nonzero(grow(a, limit, steps))))
    b = RNG.random(SHAPE) < 0.97
    solid = frame(spark, {"m": b.astype(int)}).filter("m = 1")
    assert points(G.erode(solid, dims(spark, SHAPE), connectivity, steps)) == set(zip(*np.nonzero(shrink(b, limit, steps))))


def test_border_marks_both_sides_but_not_the_image_edge(spark):
    a = np.zeros((3, 3, 3), int)
    a[1, 1, 1] = 1
    out = G.borders(frame(spark, {"seg": a})).filter("border")
    assert points(out) == {(1, 1, 1), (0, 1, 1), (2, 1, 1), (1, 0, 1), (1, 2, 1), (1, 1, 0), (1, 1, 2)}
    full = np.ones((3, 3, 3), int)
    assert G.borders(frame(spark, {"seg": full})).filter("border").count() == 0
    zero = G.multi_label_borders(frame(spark, {"seg": full}), [1], connectivity=6)
    assert zero.count() == 26


@pytest.mark.parametrize("mode", ["reflect", "nearest"])
def test_gaussian_with_kernel_wider_than_the_image(spark, mode):
    a = RNG.random((3, 4, 5))
    out = dense(G.gaussian(frame(spark, {"v": a}), dims(spark, a.shape), {"o": "v"}, 1.5, mode), a.shape, "o")
    assert np.allclose(out, gaussian(a, 1.5, mode))


@pytest.mark.parametrize("connectivity,limit", [(6, 1), (18, 2), (26, 3)])
def test_components_match_flood_fill(spark, connectivity, limit):
    a = RNG.random((9, 8, 10)) < 0.3
    found = C.voxel_components(frame(spark, {"m": a.astype(int)}).filter("m = 1"), connectivity)
    want = components(a, limit)
    pairs = {(r["component"], int(want[r["x"], r["y"], r["z"]])) for r in found.collect()}
    assert len(pairs) == want.max()
    # component ids keep the array order of first voxels
    assert [n for _, n in sorted(pairs)] == list(range(1, want.max() + 1))


# Where blocks of 32 meet, so that a small volume lies in eight of them.
CORNER = np.array([28, 27, 29])


def cells(spark, mask, corner=(0, 0, 0)):
    rows = [(1, *map(int, np.array(p) + corner)) for p in zip(*np.nonzero(mask))]
    return spark.createDataFrame(rows, "subject_id long, x int, y int, z int")


@pytest.mark.parametrize("connectivity,limit", [(6, 1), (18, 2), (26, 3)])
def test_blocks_meet(spark, connectivity, limit):
    """Neighbourhoods and components of a volume that lies across eight blocks equal those of the whole array."""
    a = RNG.random((9, 10, 8)) < 0.25
    place = lambda mask: {tuple(map(int, np.array(p) + CORNER)) for p in zip(*np.nonzero(mask))}
    sparse = cells(spark, a, CORNER)
    found = {(r["x"], r["y"], r["z"]): r["component"] for r in C.voxel_components(sparse, connectivity).collect()}
    want = components(a, limit)
    assert set(found) == place(a)
    pairs = {(found[tuple(np.array(p) + CORNER)], int(want[p])) for p in zip(*np.nonzero(a))}
    assert [n for _, n in sorted(pairs)] == list(range(1, want.max() + 1))
    wide = np.zeros((60, 60, 60), bool)
    wide[tuple(slice(c, c + n) for c, n in zip(CORNER, a.shape))] = a
    if connectivity != 26:
        assert points(G.dilate(sparse, dims(spark, (60, 60, 60)), connectivity, 2)) == set(zip(*map(lambda i: i.tolist(), np.nonzero(grow(wide, limit, 2) if connectivity == 6 else _ball(wide, 2)))))
    full = ~(RNG.random((9, 10, 8)) < 0.02)
    if connectivity != 26:
        assert points(G.erode(cells(spark, full, CORNER), dims(spark, (60, 60, 60)), connectivity)) == place(shrink(full, limit))
    labels = RNG.integers(0, 3, a.shape)
    rows = frame(spark, {"seg": labels})
    for axis, c in zip("xyz", CORNER):
        rows = rows.withColumn(axis, rows[axis] + int(c))
    other = np.zeros(a.shape, bool)
    for o in offsets(limit):
        here = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(o, a.shape))
        there = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(o, a.shape))
        other[here] |= labels[here] != labels[there]
    assert points(G.borders(rows, connectivity=connectivity).filter("border")) == place(other)


@pytest.mark.parametrize("corner,size", [(CORNER, 60), (np.array([28, 0, 29]), 38), (np.array([0, 27, 0]), 36)])
@pytest.mark.parametrize("steps", [1, 3])
def test_boxes_over_blocks(spark, corner, size, steps):
    """Growing, shrinking and closing with the 26-neighbourhood across blocks and at the image edge."""
    a = RNG.random((9, 9, 9)) < 0.3
    shape = (size,) * 3
    wide = np.zeros(shape, bool)
    wide[tuple(slice(c, min(c + 9, size)) for c in corner)] = a[tuple(slice(0, min(9, size - c)) for c in corner)]
    at = lambda mask: set(zip(*map(lambda i: i.tolist(), np.nonzero(mask))))
    sparse, extent = cells(spark, wide), dims(spark, shape)
    assert points(G.dilate(sparse, extent, 26, steps)) == at(grow(wide, 3, steps))
    dense_mask = grow(wide, 3, 2)
    assert points(G.erode(cells(spark, dense_mask), extent, 26, steps)) == at(shrink(dense_mask, 3, steps))
    closed = shrink(grow(wide, 3, steps), 3, steps)
    labelled = sparse.selectExpr("*", "50 AS seg")
    assert points(G.closing_difference(labelled, extent, 33, steps)) == at(closed ^ wide)
    assert points(G.cortex_border(labelled, extent)) == at(wide & ~shrink(wide, 3))


def _ball(mask, reach):
    """Two steps of the 18-neighbourhood as one set of offsets."""
    out = mask.copy()
    for p in zip(*np.nonzero(mask)):
        for o in itertools.product(range(-reach, reach + 1), repeat=3):
            if sum(map(abs, o)) <= 2 * reach:
                out[tuple(np.array(p) + o)] = True
    return out


@pytest.mark.parametrize("steps", [1, 3, 7])
def test_largest_grown_component_equals_that_of_the_grown_mask(spark, steps):
    shape = (40, 44, 48)
    for density in (0.0006, 0.004):
        a = RNG.random(shape) < density
        a[0, 0, :3] = a[-1, -1, -3:] = True  # grown against the image edge
        body = largest(grow(a, 3, steps))
        got = points(C.in_largest_grown(cells(spark, a), dims(spark, shape), steps))
        assert got == set(zip(*map(lambda i: i.tolist(), np.nonzero(a & body))))


def test_equal_grown_components_keep_the_first(spark):
    a = np.zeros((30, 3, 3), bool)
    a[5, 1, 1] = a[24, 1, 1] = True
    assert points(C.in_largest_grown(cells(spark, a), dims(spark, a.shape), 2)) == {(5, 1, 1)}


def test_equal_components_keep_the_first(spark):
    a = np.zeros((5, 1, 1), int)
    a[0] = a[4] = 1
    assert points(C.keep_largest(frame(spark, {"m": a}).filter("m = 1"))) == {(0, 0, 0)}


def test_long_chain_component(spark):
    rows = [(1, i, 0, 0) for i in range(300)]
    chain = spark.createDataFrame(rows, "subject_id long, x int, y int, z int")
    out = C.voxel_components(chain, 6)
    assert out.select("component").distinct().count() == 1 and out.count() == 300


def test_nearest_points_with_copies_and_a_dense_cluster(spark):
    cluster = np.round(RNG.normal(0, 0.01, (400, 3)), 6)
    far = RNG.random((60, 3)) * 50
    t = np.vstack([cluster, np.repeat(cluster[:1], 300, axis=0), far])
    q = np.vstack([RNG.random((50, 3)) * 50, cluster[:20] + 0.003])
    targets = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(t)], "subject_id long, tid long, x double, y double, z double")
    queries = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(q)], "subject_id long, qid long, x double, y double, z double")
    got = {r["qid"]: (r["tid"], r["distance"]) for r in nearest_points(queries, targets).collect()}
    d = np.linalg.norm(q[:, None] - t[None], axis=2)
    for i in range(len(q)):
        assert abs(got[i][1] - d[i].min()) < 1e-9
        assert got[i][0] == np.flatnonzero(np.isclose(d[i], d[i].min(), atol=1e-12))[0]


def test_leaves_stay_small_beside_an_outlier(spark):
    """100,000 points in a box that a far outlier makes tiny, and most of them in one plane."""
    dense_points = spark.range(100_000).selectExpr(
        "1L AS subject_id", "id AS tid", "IF(id % 10 < 9, 0D, id * 1e-9) AS x", "(id % 1000) * 1e-6 AS y", "(id div 1000) * 1e-6 AS z"
    )
    outlier = spark.createDataFrame([(1, -1, 1e12, -1e12, 1e12), (2, 5, 0.0, 0.0, 0.0)], dense_points.schema)
    points, leaves, levels = split_points(dense_points.unionByName(outlier), ["subject_id"], 500)
    sizes = [r["count"] for r in points.groupBy("subject_id", "path").count().collect()]
    assert sum(sizes) == 100_002 and max(sizes) <= 500 and leaves.count() == len(sizes)
    assert len(levels) <= 6
    queries = spark.createDataFrame([(1, k, 5e-7 * k, 1e-6 * k, 2e-6 * k) for k in range(40)] + [(1, 99, 1e12, 0.0, 0.0), (2, 1, 3.0, 4.0, 0.0), (3, 1, 0.0, 0.0, 0.0)],
                                    "subject_id long, qid long, x double, y double, z double")
    got = {(r["subject_id"], r["qid"]): (r["tid"], r["distance"]) for r in nearest_points(queries, dense_points.unionByName(outlier), leaf_points=500).collect()}
    all_points = [(r["tid"], r["x"], r["y"], r["z"]) for r in dense_points.unionByName(outlier).filter("subject_id = 1").collect()]
    tids, xyz = np.array([p[0] for p in all_points]), np.array([p[1:] for p in all_points])
    for r in queries.filter("subject_id = 1").collect():
        d2 = ((np.array([r["x"], r["y"], r["z"]]) - xyz) ** 2).sum(1)
        assert got[1, r["qid"]] == (tids[d2 == d2.min()].min(), pytest.approx(d2.min() ** 0.5, abs=1e-15))
    assert got[2, 1] == (5, 5.0) and got[3, 1] == (None, None)


def test_partial_volume_shares_add_up(spark):
    seg = np.repeat(np.array([1, 1, 2, 2])[:, None, None], 3, 1).repeat(3, 2)
    pv = np.repeat(np.array([10.0, 12.0, 30.0, 40.0])[:, None, None], 3, 1).repeat(3, 2)
    v, head = frame(spark, {"seg": seg, "norm": pv}), spark.createDataFrame([(1, 2.0)], "subject_id long, vox_vol double")
    vol = {r["seg"]: r["volume"] for r in P.partial_volume_volumes(v, dims(spark, seg.shape), head).collect()}
    assert abs(sum(vol.values()) - seg.size * 2.0) < 1e-9
    maps = {(r["x"], r["y"], r["z"]): r for r in P.partial_volume_maps(v, dims(spark, seg.shape)).collect()}
    # own mean 11, other mean 35: the voxel at 12 is (12 - 35) / (11 - 35) its own
    assert abs(maps[1, 1, 1]["mix"] - 23 / 24) < 1e-9 and maps[1, 1, 1]["nbr"] == 2
    # 30 lies on the other side of 35 than label 1's mean allows: (30 - 11) / (35 - 11)
    assert abs(maps[2, 1, 1]["mix"] - 19 / 24) < 1e-9


def test_clean_regions_matches_brute_force(spark):
    shape = (10, 10, 12)
    a = np.where(RNG.random(shape) < 0.05, RNG.choice([1, 4, 7, 13, 30], shape), 0)
    want = np.zeros_like(a)
    for part, steps in ((np.isin(a, [1, 2, 4, 5]), 2), ((a != 0) & ~np.isin(a, [1, 2, 4, 5]), 1)):
        keep = largest(grow(part, 3, steps))
        want += np.where(part & keep & ~np.isin(a, [13, 20]), a, 0)
    found = components(want > 0)
    sizes = np.bincount(found.ravel())
    want[(sizes <= 3)[found]] = 0
    out = cleanup.clean_regions(frame(spark, {"seg": a}), dims(spark, shape), reach=(2, 1))
    assert np.array_equal(dense(out, shape, "seg"), want)


EV_SHAPE = (8, 8, 100)


def embeddings(spark, folder, high, label):
    """The table behind ``fixtures.ev`` for one subject: seg is 5 where ``high``, else 0 or 2."""
    rng = np.random.default_rng(8)
    rows = [(z, int(label[z]), [0.4 if high[p % 8, p // 8, z] else rng.choice([-0.2, 0.1]).item() for p in range(64)]) for z in range(100)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    x, y, z = np.indices(EV_SHAPE)
    return (x // 4 + 2 * (y // 3) + z // 10) % 5


def test_the_clean_regions_query_runs_with_the_default_reach(spark, tmp_path):
    from volspark.queries.cleanup_ops import clean_regions

    high, label = np.zeros(EV_SHAPE, bool), np.full(100, 6)
    # parts of other labels at gaps of 9 and 25 voxels, of optic ones (1 and 5) at gaps of 12 and 20
    high[1:6, 1:5, 0:6] = high[2:5, 1:4, 15:19] = high[2:5, 1:4, 44:48] = True
    for low, up in ((50, 56), (68, 70), (90, 92)):
        high[1:6, 1:6, low:up], label[low:up] = True, 1
    a = np.where(high, embeddings(spark, tmp_path, high, label) + label, 0)
    kept = {}
    for reach in ((7, 5), (1, 1)):
        want, optic = np.zeros_like(a), np.isin(a, cleanup.OPTIC)
        for part, steps in zip((optic, (a != 0) & ~optic), reach, strict=True):
            want += np.where(part & largest(grow(part, 3, steps)) & ~np.isin(a, cleanup.NOT_REPORTED), a, 0)
        found = components(want > 0)
        want[(np.bincount(found.ravel()) <= 3)[found]] = 0
        kept[reach] = want
    assert not np.array_equal(kept[7, 5], kept[1, 1])
    assert np.array_equal(dense(clean_regions(spark, str(tmp_path)), EV_SHAPE, "l"), kept[7, 5])


def test_the_fill_by_blur_query_runs_with_the_default_sigma(spark, tmp_path):
    from volspark.queries.cleanup_ops import fill_unknown_by_blur

    high = np.zeros(EV_SHAPE, bool)
    high[1:7, 1:8, 20:45] = high[0:3, 2:6, 60:75] = True
    a = np.where(high, 1, embeddings(spark, tmp_path, high, np.zeros(100)) + 1)
    ring = grow(a == 1, 2)
    rivals = [k for k in (2, 3, 4) if (ring & (a == k)).any()]
    filled = {s: np.where(a == 1, np.array(rivals)[np.argmax([gaussian((a == k) * 1.0, s, "reflect").round(12) for k in rivals], 0)], a) for s in (5.0, 0.5)}
    assert not np.array_equal(filled[5.0], filled[0.5])
    assert np.array_equal(dense(fill_unknown_by_blur(spark, str(tmp_path)), EV_SHAPE, "l"), filled[5.0])


def test_split_parcels_matches_brute_force(spark):
    shape = (12, 6, 6)
    a = RNG.choice([0, 1003, 1011], shape, p=[0.6, 0.2, 0.2])
    a[1:3, 2:4, 2:4], a[9:11, 2:4, 2:4] = 2, 41
    mid = {w: np.argwhere(largest(a == w)).mean(0) for w in (2, 41)}
    want = a.copy()
    for p in (1003, 1011):
        found = components(a == p)
        for n in range(1, found.max() + 1):
            c = np.argwhere(found == n).mean(0)
            if np.linalg.norm(c - mid[41]) < np.linalg.norm(c - mid[2]):
                want[found == n] = p + 1000
    right = gaussian((a == 41) * 1.0, 1.0, "reflect") - gaussian((a == 2) * 1.0, 1.0, "reflect") > 1e-12
    both = np.isin(want, [1011, 2011])
    want[both & right], want[both & ~right] = 2011, 1011
    out = cleanup.split_parcels(frame(spark, {"seg": a}), dims(spark, shape), sigma=1.0)
    assert np.array_equal(dense(out, shape, "seg"), want)


def _fill(labels, holes, candidates):
    out = labels.copy()
    there = [c for c in candidates if (labels == c).any()]
    for h in np.argwhere(holes):
        d = [int(np.sqrt(((np.argwhere(labels == c) - h) ** 2).sum(1).min())) for c in there]
        out[tuple(h)] = there[int(np.argmin(d))]
    return out


@pytest.mark.parametrize("manual", [False, True])
def test_merge_cerebellum_matches_brute_force(spark, manual):
    shape = (6, 6, 7)
    seg = RNG.choice([0, 7, 8, 46, 47], shape, p=[0.3, 0.1, 0.25, 0.1, 0.25])
    part = RNG.choice([0, 1, 5, 9, 12, 30], shape)
    cortex = part != 0 if manual else np.isin(seg, [8, 47])
    work = np.where(cortex, np.where((part >= 29) & (part <= 34), 36, part), 0)
    work[seg == 7], work[seg == 46] = 37, 38
    white = np.isin(work, [37, 38])
    holes = ((grow(white) ^ white) & (grow(cortex) ^ cortex)) | np.isin(work, [9, 36])
    work = _fill(work, holes, [37, 38] if manual else cleanup.FILL_LABELS)
    kept = np.zeros_like(work)
    for c in np.unique(work[work != 0]):
        kept[largest(work == c)] = c
    out = _fill(kept, kept != 0, cleanup.FILL_LABELS)
    whole = seg.copy()
    if manual:
        out[cortex] = part[cortex]
        whole[np.isin(seg, [8, 47])] = 0
        whole[out == 37], whole[out == 38] = 7, 46
        whole[(out != 0) & ~np.isin(out, [37, 38])] = 8
    else:
        out[seg == 7], out[seg == 46] = 37, 38
    got = cleanup.merge_cerebellum(frame(spark, {"part": part, "seg": seg}), dims(spark, shape), manual)
    assert np.array_equal(dense(got, shape, "part"), out)
    assert np.array_equal(dense(got, shape, "seg"), whole)


def test_near_holes_are_filled_inside_blocks(spark, monkeypatch):
    shape = (9, 5, 70)
    labels = RNG.choice([0, 1, 2, 3], shape, p=[0.9, 0.04, 0.03, 0.03])
    holes = RNG.random(shape) < 0.4
    labels[:, :, 30:50], holes[:, :, 36:44] = 0, False
    labels[4, 2, 40] = 2  # beyond other labels, but at most 4 voxels from any hole round it
    voxels, asked = frame(spark, {"seg": labels}), frame(spark, {"h": holes.astype(int)}).filter("h = 1")
    far = holes.copy()
    for h in np.argwhere(holes):
        far[tuple(h)] = int(np.sqrt(((np.argwhere(labels > 0) - h) ** 2).sum(1).min())) > cleanup.NEAR
    got = dense(cleanup.fill_by_distance(voxels, asked, [3, 1, 2]), shape, "seg")
    assert far.any() and np.array_equal(got, _fill(labels, holes, [3, 1, 2]))
    # without far holes nothing is paired with the whole subject
    monkeypatch.setattr(cleanup, "nearest_points", None)
    near = frame(spark, {"h": (holes & ~far).astype(int)}).filter("h = 1")
    got = dense(cleanup.fill_by_distance(voxels, near, [3, 1, 2]), shape, "seg")
    assert np.array_equal(got, _fill(labels, holes & ~far, [3, 1, 2]))

import numpy as np
import pytest
from volumes import dims, frame

from volspark.operators import agreement as A
from volspark.operators import align, labels, mapping, measures, mesh, training
from volspark.operators import regions as R
from volspark.plans import joins, ordered, storage

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def bag(spark):
    values = np.round(RNG.normal(100, 30, 3000), 1)
    values[:1000] = 55.5
    rows = [(i % 3, int(i % 5), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "subject_id long, seg int, norm double")


def test_bucketed_percentiles_equal_numpy(spark, bag):
    got = ordered.exact_percentiles(bag, ["subject_id"], "norm", {"p1": 0.01, "p50": 0.5, "p90": 0.9}, direct_rows=5, buckets=7)
    data = bag.toPandas()
    for r in got.collect():
        want = np.percentile(data[data.subject_id == r["subject_id"]].norm, [1, 50, 90])
        assert np.allclose([r["p1"], r["p50"], r["p90"]], want)


def test_bucketed_global_ranks(spark, bag):
    got = ordered.distinct_ranks(bag, "norm", direct_rows=5, buckets=7).collect()
    assert [r["norm"] for r in sorted(got, key=lambda r: r["rank"])] == sorted({r["norm"] for r in got})
    assert sorted(r["rank"] for r in got) == list(range(len(got)))


def test_robust_trim_with_copies(spark, bag):
    data = bag.toPandas()
    for r in R.robust_partials(bag, 0.7, direct_rows=5, buckets=4).collect():
        v = np.sort(data[(data.subject_id == r["subject_id"]) & (data.seg == r["seg"])].norm.to_numpy())
        k = int((1 - 0.7) / 2 * len(v))
        kept = v[k : len(v) - k]
        assert (r["n_voxels"], r["n_values"], r["v_min"], r["v_max"]) == (len(v), len(kept), kept[0], kept[-1])
        assert abs(r["v_sum"] - kept.sum()) < 1e-6 and abs(r["v_std"] - kept.std(ddof=1)) < 1e-6


def test_one_voxel_and_absent_labels(spark):
    v = spark.createDataFrame([(1, 4, 2.0)], "subject_id long, seg int, norm double")
    head = spark.createDataFrame([(1, 1.0)], "subject_id long, vox_vol double")
    lut = spark.createDataFrame([(4, "four"), (9, "nine")], "id int, label_name string")
    rows = {r["seg"]: r for r in R.region_stats(v, head, lut, report_empty=True).collect()}
    assert rows[4]["v_std"] is None and rows[4]["n_voxels"] == 1
    assert rows[9]["n_voxels"] == 0 and rows[9]["v_mean"] == 0.0 and rows[9]["v_std"] == 0.0
    with pytest.raises(ValueError):
        R.choose_labels(v, ids=[4], exclude=[4])


def test_singleton_groups_equal_labels(spark, bag):
    parts = R.region_partials(bag)
    groups = spark.createDataFrame([(100 + i, i) for i in range(5)], "group_id int, member_id int")
    a = {(r["subject_id"], r["seg"]): r for r in R.stat_columns(parts).collect()}
    for r in R.stat_columns(R.merge_groups(parts, groups)).collect():
        w = a[r["subject_id"], r["seg"] - 100]
        assert r["n_voxels"] == w["n_voxels"] and abs(r["v_mean"] - w["v_mean"]) < 1e-9 and abs(r["v_std"] - w["v_std"]) < 1e-6


def test_group_ids_skip_used_ones(spark):
    groups = spark.createDataFrame([(1, 5), (1, 6), (2, 6), (2, 5), (3, 7)], "group_id int, member_id int")
    used = spark.createDataFrame([(10000,), (3,)], "id int")
    got = {tuple(r["members"]): r["group_id"] for r in R.distinct_groups(groups, used).collect()}
    assert got == {(5, 6): 10001, (7,): 10002}


def test_split_hot_join_keeps_all_rows(spark):
    big = spark.range(2000).selectExpr("if(id % 3 = 0, 7L, id % 50) AS k", "id AS v")
    small = spark.range(40).selectExpr("id AS k", "id * 10 AS w")
    a = joins.split_hot_join(big, small, "k", parts=4)
    b = big.join(small, "k", "left")
    assert a.count() == 2000 and a.exceptAll(b).count() == 0
    forced = joins.attach(big, small, "k", "inner", max_rows=1)
    assert forced.count() == big.join(small, "k").count()


def test_forward_fill_crosses_chunks(spark):
    rows = [(1, i, "a" if i == 3 else "b" if i == 50 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "g int, at int, v string")
    got = {r["at"]: r["f"] for r in ordered.forward_fill(df, ["g"], "at", "v", "f", chunk=8).collect()}
    assert got[2] is None and got[3] == "a" and got[49] == "a" and got[50] == "b" and got[99] == "b"
    before = {r["at"]: r["f"] for r in ordered.forward_fill(df, ["g"], "at", "v", "f", chunk=8, include_self=False).collect()}
    assert before[3] is None and before[50] == "a" and before[51] == "b"


def test_forward_fill_of_a_written_table_is_one_window(spark):
    rows = [(g, i, "a" if i == 3 else None) for g in (1, 2) for i in range(100)]
    filled = ordered.forward_fill(storage.materialize(spark.createDataFrame(rows, "g int, at int, v string")), ["g"], "at", "v", "f", chunk=8)
    assert "Join" not in filled._jdf.queryExecution().optimizedPlan().toString()
    assert all((r["f"] == "a") == (r["at"] >= 3) for r in filled.collect())


def test_label_above_the_map_is_an_error(spark):
    m = spark.createDataFrame([(1, 10), (3, 30)], "src int, dst int")
    ok = spark.createDataFrame([(1,), (2,), (3,)], "seg int")
    assert sorted(r[0] for r in mapping.map_labels(ok, m).collect()) == [0, 10, 30]
    with pytest.raises(Exception, match="above the map"):
        mapping.map_labels(spark.createDataFrame([(4,)], "seg int"), m).collect()
    with pytest.raises(ValueError, match="30"):
        mapping.chain_maps(m, spark.createDataFrame([(10, 1)], "src int, dst int"))


def test_map_and_reverse_is_identity(spark):
    m = spark.createDataFrame([(i, 100 - i) for i in range(10)], "src int, dst int")
    assert mapping.bijective(m).first()["bijective"]
    back = mapping.chain_maps(m, mapping.reverse_map(m))
    assert all(r["src"] == r["dst"] for r in back.collect())


def test_planes_and_back(spark):
    v = frame(spark, {"seg": RNG.integers(0, 9, (3, 4, 5))})
    for plane in labels.PLANE_ORDERS:
        back = labels.from_plane(labels.to_plane(v, plane), plane)
        assert back.exceptAll(v).count() == 0


def test_catalogue_units_and_leaves():
    for key in measures.CATALOGUE:
        assert measures.unit_of(key) in ("mm^3", "unitless")
    assert measures.expand("SupraTentorialNotVent") == [
        ("num", "BrainSeg", 1.0), ("num", "CerebellarGM", -1.0), ("num", "CerebellarWM", -1.0), ("num", "VentricleChoroidVol", -1.0), ("num", "TFFC", -1.0),
    ]
    assert measures.leaves(["MaskVol-to-eTIV"]) == ["EstimatedTotalIntraCranialVol", "Mask"]


def test_integer_measures_stay_integer(spark):
    values = spark.createDataFrame([(1, "rhSurfaceHoles", 3.0, True), (1, "lhSurfaceHoles", 4.0, True)], "subject_id long, key string, value double, is_int boolean")
    head = spark.createDataFrame([(1, 0.5)], "subject_id long, vox_vol double")
    row = measures.derived_measures(values, ["SurfaceHoles"], head).first()
    assert row["value"] == 7.0 and row["is_int"] and row["unit"] == "unitless"


def test_closed_tetrahedron(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 0.0, 1.0, 0.0), (1, 3, 0.0, 0.0, 1.0)], "subject_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(1, 0, 0, 2, 1), (1, 1, 0, 1, 3), (1, 2, 0, 3, 2), (1, 3, 1, 2, 3)], "subject_id long, fid long, v0 long, v1 long, v2 long")
    row = mesh.euler_numbers(f).first()
    assert row["euler"] == 2 and row["holes"] == 0
    assert abs(mesh.enclosed_volume(f, v).first()["volume"] - 1 / 6) < 1e-12


def _smooth(faces, start, cortex):
    """Plain version of filling and smoothing."""
    n = len(start)
    lab = np.array(start)
    fill = lab.max() + 1
    lab[cortex & np.isin(lab, [-1, 0])] = fill

    def ring(fs):
        a = np.eye(n, dtype=bool)
        for t in fs:
            for i in t:
                a[i, list(t)] = True
        return a

    def vote(a, lab, only=None):
        out = lab.copy()
        for v in range(n):
            near = lab[a[v]]
            if a[v].sum() == 1 or len(set(near)) == 1 or (only is not None and lab[v] != only):
                continue
            near = near[near != only] if only is not None else near
            values, counts = np.unique(near, return_counts=True)
            out[v] = values[counts.argmax()]
        return out

    fs = [t for t in faces if cortex[list(t)].all()]
    left = (lab == fill).sum()
    while left:
        lab = vote(ring(fs), lab, fill)
        now = (lab == fill).sum()
        if now == left:
            fs = [t for t in fs if not (lab[list(t)] == fill).any()]
            lab[lab == fill] = 0
            break
        left = now
    a = ring(fs)
    a2 = (a.astype(int) @ a) > 0
    a4 = (a2.astype(int) @ a2) > 0
    for r in (a4, a2, a):
        lab = vote(r, lab)
    return np.where(cortex, lab, -1)


def test_smooth_labels_matches_brute_force(spark):
    w, h = 8, 9
    faces = []
    for i in range(h - 1):
        for j in range(w - 1):
            v = i * w + j
            faces += [(v, v + 1, v + w), (v + 1, v + w + 1, v + w)]
    start = RNG.choice([-1, 0, 1, 2, 3], w * h)
    cortex = RNG.random(w * h) < 0.9
    f = spark.createDataFrame([(1, i, *t) for i, t in enumerate(faces)], "subject_id long, fid long, v0 long, v1 long, v2 long")
    lab = spark.createDataFrame([(1, i, int(s)) for i, s in enumerate(start)], "subject_id long, vid long, label int")
    inside = spark.createDataFrame([(1, int(i)) for i in np.flatnonzero(cortex)], "subject_id long, vid long")
    got = {r["vid"]: r["label"] for r in mesh.smooth_labels(f, lab, inside).collect()}
    want = _smooth(faces, start, cortex)
    assert [got[i] for i in range(w * h)] == list(want)


def test_flipped_alignment_halves_the_turn(spark):
    shape = (20, 16, 16)
    a = np.zeros(shape, int)
    a[3:6, 4:7, 5:8], a[14:17, 4:7, 5:8] = 1, 2
    a[4:7, 10:13, 2:5], a[13:16, 10:13, 2:5] = 3, 4
    a[2:4, 8:10, 12:14], a[16:18, 8:10, 12:14] = 5, 6
    sides = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "src int, dst int")
    m = np.array(align.align_flipped(frame(spark, {"seg": a}).filter("seg > 0"), sides, dims(spark, shape)).first()["m"])
    assert np.allclose(m, np.eye(4), atol=1e-6)
    turn = align.half_way(np.array([[0.0, -1, 0, 2], [1, 0, 0, 1], [0, 0, 1, 5], [0, 0, 0, 1]]))
    assert np.allclose(turn @ turn, [[0, -1, 0, 2], [1, 0, 0, 1], [0, 0, 1, 5], [0, 0, 0, 1]])


def test_dice_is_symmetric_and_empty_class_is_null(spark):
    rows = [(1, 1, 1), (1, 1, 2), (1, 2, 2), (1, 3, 1)]
    pairs = spark.createDataFrame(rows, "subject_id long, seg int, pred int")
    a = {r["cls"]: r["dice"] for r in A.scores(A.class_counts(A.confusion(pairs))).collect()}
    b = {r["cls"]: r["dice"] for r in A.scores(A.class_counts(A.confusion(pairs, "pred", "seg"))).collect()}
    assert a == b and a[3] == 0.0


def test_random_draws_do_not_change_on_recompute(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000)
    draw = df.select(training.hash_normal(3, "id").alias("v"))
    assert draw.repartition(7).agg(F.sum("v")).first()[0] == pytest.approx(draw.agg(F.sum("v")).first()[0])
    row = draw.agg(F.avg("v").alias("m"), F.stddev("v").alias("s")).first()
    assert abs(row["m"]) < 0.05 and abs(row["s"] - 1) < 0.05

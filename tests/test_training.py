"""Random draws, slabs with failing subjects and single modalities."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspark.operators import training as T


def volume(spark, subject, n=6, label=lambda x, y, z: 1 + (x + y) % 3, value=1.0):
    rows = [(subject, x, y, z, label(x, y, z), value) for x in range(n) for y in range(n) for z in range(n)]
    return spark.createDataFrame(rows, "subject_id long, x int, y int, z int, seg int, norm double")


def test_failing_subjects_are_logged_and_the_others_built(spark):
    good = volume(spark, 1)
    bad = [volume(spark, 2, label=lambda x, y, z: 99 if (x, y, z) == (0, 0, 0) else 1), volume(spark, 3), volume(spark, 4, n=7), volume(spark, 5, value=float("nan"))]
    voxels = good
    for b in bad:
        voxels = voxels.unionByName(b)
    dims = spark.createDataFrame([(k, 6, 6, 6) for k in (1, 2, 4, 5)], "subject_id long, nx int, ny int, nz int")
    mapping = spark.createDataFrame([(0, 0), (1, 4), (2, 5), (3, 6)], "src int, dst int")
    slabs, log = T.build_slabs_logged(voxels, dims, "coronal", 1, 0, mapping)
    assert {r["subject_id"]: r["state"] for r in log.collect()} == {
        2: "Failed: label above the map: 99", 3: "Failed: no image size", 4: "Failed: voxel outside the image", 5: "Failed: voxel without an intensity",
    }
    got = slabs.collect()
    assert {r["subject_id"] for r in got} == {1} and len(got) == 216 and {r["label"] for r in got} == {4, 5, 6}
    alone = T.build_slabs(good, dims, "coronal", 1, 0, mapping).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, alone))


def test_draws_hang_on_keys_and_seed_alone(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.lit(2.0).alias("s"))
    draw = rows.select("k", T.jitter("s", "k", 0.5, 0.25, 3).alias("v"))
    a = {r["k"]: r["v"] for r in draw.collect()}
    b = {r["k"]: r["v"] for r in draw.repartition(7, "v").collect()}
    assert a == b and a != {r["k"]: r["v"] for r in rows.select("k", T.jitter("s", "k", 0.5, 0.25, 4).alias("v")).collect()}
    v = np.array(list(a.values()))
    assert abs(v.mean() - 2.25) < 0.02 and abs(v.std() - 0.5) < 0.02 and len(set(a.values())) == len(a)


def test_synthetic_intensity_follows_its_classes(spark):
    v = volume(spark, 1, n=20)
    classes = spark.createDataFrame([(1, 10.0, 1.0), (2, 50.0, 0.0), (3, 90.0, 4.0)], "seg int, mean double, std double")
    out = T.synthetic_intensity(v, classes, 5).groupBy("seg").agg(F.avg("synthetic").alias("m"), F.stddev_pop("synthetic").alias("s")).collect()
    for r in out:
        mean, std = {1: (10, 1), 2: (50, 0), 3: (90, 4)}[r["seg"]]
        assert abs(r["m"] - mean) < 0.2 and abs(r["s"] - std) < 0.2


def test_random_crop_keeps_its_size_and_moves(spark):
    pixels = spark.range(40).selectExpr("id AS subject_id").join(spark.range(12).selectExpr("CAST(id AS INT) AS u")).join(spark.range(9).selectExpr("CAST(id AS INT) AS v"))
    pixels = pixels.withColumn("was", F.struct("u", "v"))
    got = T.crop_slices(pixels, (5, 4), F.lit(12), F.lit(9), "subject_id", 11).collect()
    corners = {}
    for r in got:
        corners.setdefault(r["subject_id"], set()).add((r["was"]["u"] - r["u"], r["was"]["v"] - r["v"]))
    assert len(got) == 40 * 20 and all(len(c) == 1 for c in corners.values())
    assert len({c for cs in corners.values() for c in cs}) > 10 and all(0 <= a <= 7 and 0 <= b <= 5 for cs in corners.values() for a, b in cs)


def test_single_modalities_take_both_channels(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "k long, slab array<double>")
    r = T.join_modalities(one, None, ["k"]).first()
    assert (list(r["slab"]), r["w1"], r["w2"]) == ([1.0, 2.0, 1.0, 2.0], 1.0, 0.0)
    r = T.join_modalities(None, one, ["k"]).first()
    assert (r["w1"], r["w2"]) == (0.0, 1.0)
    with pytest.raises(ValueError, match="no modality"):
        T.join_modalities(None, None, ["k"])


def test_noisy_zoom_has_a_floor(spark):
    rows = spark.range(500).select(F.col("id").alias("k"), F.lit(20.0).alias("zx"), F.lit(1.0).alias("sx"))
    noisy = [r[0] for r in rows.select(T.zoomed_scale(["zx"], ["sx"], 1.0, "k", 2)[0]).collect()]
    plain = rows.select(T.zoomed_scale(["zx"], ["sx"])[0]).first()[0]
    assert math.isclose(plain, 0.05) and min(noisy) == 0.1 and max(noisy) > 0.15

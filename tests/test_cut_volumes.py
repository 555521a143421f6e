"""Queries over volumes and meshes whose last subject is stored in part only equal their check SQL."""

import os

import oracle
import pytest

import __spark_entry__ as entry

SOURCE = "/root/testdata/sf0.001"
NAMES = [
    "box_mean_7_reflect", "box_sum_3", "close_26", "closing_difference", "dilate_6", "dilate_18_twice", "gaussian_blur", "thick_slices",
    "vertex_normals", "voxel_weights",
]


@pytest.fixture(scope="module")
def cut(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cut")
    for name in os.listdir(SOURCE):
        if name != "embeddings.parquet":
            os.symlink(f"{SOURCE}/{name}", folder / name)
    con = oracle.duck(SOURCE)
    con.execute(f"COPY (SELECT * FROM embeddings WHERE vec_id < 156) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, cut, name):
    assert oracle.compare(spark, oracle.duck(cut), cut, entry.queries()[name], entry.oracle_sql()[name])[0] is None


def test_logged_slabs_are_those_of_the_planes_along_x(spark, tmp_path):
    # 76 slices of the last subject: the planes along x and those along y keep other voxels
    for name in os.listdir(SOURCE):
        if name != "embeddings.parquet":
            os.symlink(f"{SOURCE}/{name}", tmp_path / name)
    oracle.duck(SOURCE).execute(f"COPY (SELECT * FROM embeddings WHERE vec_id < 176) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    folder, name = str(tmp_path), "training_slabs_logged"
    assert oracle.compare(spark, oracle.duck(folder), folder, entry.queries()[name], entry.oracle_sql()[name])[:2] == (None, 2)

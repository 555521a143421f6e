"""The physical plans keep to what scales."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", ["region_stats_basic", "border_6", "view_aggregation_argmax", "mode_filter", "stats_regression", "class_counts", "log_error_scan"])
def test_no_cartesian_product_and_no_python(spark, name):
    text = plan(spark, name)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert word not in text


def test_scan_reads_only_what_is_used(spark):
    text = plan(spark, "region_stats_basic")
    scans = [line for line in text.splitlines() if line.startswith("ReadSchema") and "l_" in line]
    assert scans and all("l_quantity" not in s and "l_shipdate" not in s for s in scans)


def test_fusion_shuffles_voxels_once(spark):
    text = plan(spark, "view_aggregation_argmax")
    assert sum("hashpartitioning(voxel" in line for line in text.splitlines()) <= 2


class _Session:
    """As much of a session as the folder choice reads."""

    def __init__(self, master, folder=None):
        self.folder, self.master, self.applicationId = folder, master, f"{master}-{folder}"
        self.conf = self.sparkContext = self

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default


def test_shared_folder_is_taken_from_the_session():
    from volspark.plans.storage import shared_folder

    assert shared_folder(_Session("yarn", "/shared/x")) == "/shared/x"
    assert shared_folder(_Session("local[2]", "/shared/x")) == "/shared/x"
    local = _Session("local[2]")
    assert shared_folder(local) == shared_folder(local) and shared_folder(local).startswith("/tmp/spark-")
    with pytest.raises(RuntimeError):
        shared_folder(_Session("yarn"))


def test_intermediate_tables_can_be_released(spark):
    from volspark.plans.storage import known_rows, materialize, release, shared_folder

    out = materialize(spark.range(5), "probe")
    name = out.inputFiles()[0]
    assert shared_folder(spark) in name and known_rows(out) == 5 and out.count() == 5
    release(out)
    assert not Path(name.removeprefix("file:").replace("///", "/")).exists()


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_joins_beyond_the_bound_do_not_double_the_plan(spark, monkeypatch):
    from volspark.operators.components import graph_components
    from volspark.plans import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    sizes = []
    for length in (30, 120):
        nodes = spark.range(length).selectExpr("0L AS subject_id", "id")
        edges = nodes.filter(f"id < {length - 1}").selectExpr("subject_id", "id AS src", "id + 1 AS dst")
        out = graph_components(nodes, edges)
        sizes.append(_scans(out))
        assert {r["component"] for r in out.collect()} == {0} and out.count() == length
    assert sizes[0] == sizes[1] and sizes[1] <= 8


def test_nearest_beyond_the_bound_keeps_its_plan(spark, monkeypatch):
    from volspark.operators.nearest import nearest_points
    from volspark.plans import joins

    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    sizes = []
    for count in (100, 3000):
        t = spark.range(count).selectExpr("0L AS subject_id", "id AS tid", "double(id % 17) AS x", "double(id % 23) AS y", "double(id) AS z")
        q = spark.createDataFrame([(0, 1, 3.0, 4.0, 20.2), (7, 2, 0.0, 0.0, 0.0)], "subject_id long, qid long, x double, y double, z double")
        out = nearest_points(q, t)
        sizes.append(_scans(out))
        rows = {r["qid"]: (r["tid"], r["distance"]) for r in out.collect()}
        assert rows[2] == (None, None) and rows[1][0] is not None
    assert abs(sizes[0] - sizes[1]) <= 2 and max(sizes) <= 12


def test_long_rows_are_not_broadcast(spark, monkeypatch):
    from pyspark.sql import functions as F

    from volspark.plans import joins

    monkeypatch.setattr(joins, "BROADCAST_BYTES", 1000)
    big = spark.range(50).withColumnRenamed("id", "k")
    wide = spark.range(20).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 500).alias("t"))
    thin = spark.range(20).select(F.col("id").alias("k"), (F.col("id") + 1).alias("t"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for costly in (True, False):
        assert joins.attach(big, wide, "k", costly=costly).filter("t IS NOT NULL").count() == 20
        # beyond the bound the hot keys are split off
        assert "Union" in plan(joins.attach(big, wide, "k", "inner", costly=costly))
        assert "Union" not in plan(joins.attach(big, thin, "k", costly=costly))
        assert "BroadcastHashJoin" in plan(joins.attach(big, thin, "k", costly=costly))


def test_groups_without_members_get_zeros(spark):
    from volspark.operators.regions import region_stats

    voxels = spark.createDataFrame([(1, 2, 5.0), (1, 2, 7.0), (1, 3, 1.0)], "subject_id long, seg int, norm double")
    headers = spark.createDataFrame([(1, 1.0)], "subject_id long, vox_vol double")
    groups = spark.createDataFrame([(100, 2), (100, 3), (200, 9)], "group_id int, member_id int")
    for robust in (None, 0.5):
        rows = {r["seg"]: r for r in region_stats(voxels, headers, groups=groups, report_empty=True, robust=robust).collect()}
        assert rows[200]["n_voxels"] == 0 and rows[200]["volume"] == 0 and rows[200]["v_mean"] == 0
        assert rows[100]["n_voxels"] == 3
    assert 200 not in {r["seg"] for r in region_stats(voxels, headers, groups=groups).collect()}

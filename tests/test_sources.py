"""Settings files, manifests and batch lists by hand-made files."""

import pytest
from pyspark.sql import functions as F

from volspark.operators import labels as L
from volspark.operators import mesh as H
from volspark.sources import manifest as M
from volspark.sources import settings as Y


def test_settings_of_the_known_shapes():
    text = """
# thresholds
default_threshold: 0.01   # for all others

thresholds:
 BrainSegVol: 0.1
 'lh:Vol': 0.2
 7: 1
structs:
  - 'eTIV'
  - Mask # last
labels: [2, 3, # first row
         4]
errors:
 - "error:"
 - "a # b"
empty:
flag: true
"""
    assert Y.parse_settings(text) == {
        "default_threshold": 0.01, "thresholds": {"BrainSegVol": 0.1, "lh:Vol": 0.2, 7: 1}, "structs": ["eTIV", "Mask"], "labels": [2, 3, 4],
        "errors": ["error:", "a # b"], "empty": None, "flag": True,
    }
    for bad in ("no colon here", "a:\n  b:\n    c: 1", "a:\n - 1\n b: 2", "a:\n  b: 1\n  - 2"):
        with pytest.raises(ValueError, match="line"):
            Y.parse_settings(bad)


def test_settings_files_become_tables(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("thresholds:\n  Left: 0.1\n  Right: 0.3\nstructs:\n - Left\n")
    table, default, structs = Y.read_thresholds(spark, str(tmp_path / "t.yaml"))
    assert {r["struct_name"]: r["threshold"] for r in table.collect()} == {"Left": 0.1, "Right": 0.3} and default == 0.01 and structs == ["Left"]
    (tmp_path / "w.yaml").write_text('errors:\n - "error"\nwhitelist:\n  - "rms error"\nfiles:\n  - "a/b.log"\n')
    assert Y.read_words(spark, str(tmp_path / "w.yaml")) == (["error"], ["rms error"])
    assert Y.read_list(spark, str(tmp_path / "w.yaml"), "files") == ["a/b.log"]
    with pytest.raises(ValueError, match="no list"):
        Y.read_list(spark, str(tmp_path / "w.yaml"), "other")


def test_manifest_modes(spark, tmp_path):
    for name in ("s1/orig.mgz", "s2/orig.mgz", "s2/other.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = M.subject_manifest(spark, folder=str(tmp_path), glob="*.mgz", suffix="/orig.mgz")
    assert sorted(r["subject_id"] for r in found.collect()) == ["s1", "s2"]
    assert M.subject_manifest(spark, single="/data/s9/orig.mgz", suffix="/orig.mgz").first()["subject_id"] == "s9"
    (tmp_path / "list.txt").write_text("/a/s3\n\n  rel/s4 \n")
    listed = M.subject_manifest(spark, list_file=str(tmp_path / "list.txt"), base="/base/")
    assert sorted(tuple(r) for r in listed.collect()) == [("s3", "/a/s3"), ("s4", "/base/rel/s4")]
    with pytest.raises(Exception, match="relative path"):
        M.subject_manifest(spark, list_file=str(tmp_path / "list.txt")).collect()
    with pytest.raises(ValueError, match="give a list"):
        M.subject_manifest(spark)


@pytest.mark.parametrize(
    "line, want",
    [
        ('s=a"b c"d', ("s", "ab cd", [])),
        ("s=p --x 'one two' \"th\\\"ree\"", ("s", "p", ["--x", "one two", 'th"ree'])),
        ("s=/a=b/c.mgz  x=1\ty", ("s", "/a=b/c.mgz", ["x=1", "y"])),
        (r"s=with\ space\\ --k", ("s", "with space\\", ["--k"])),
        ("s='a''b' \"\"", ("s", "ab", [""])),
        ("s=", ("s", None, [])),
    ],
)
def test_batch_lines(spark, line, want):
    row = M.parse_batch_lines(spark.createDataFrame([(line,)], "line string")).first()
    assert (row["id"], row["path"], row["args"]) == want


@pytest.mark.parametrize("line", ['s="open', "s=a 'b", "s=a\\"])
def test_open_quotes_are_errors(spark, line):
    with pytest.raises(Exception, match="incorrect quoting"):
        M.parse_batch_lines(spark.createDataFrame([(line,)], "line string")).collect()


def test_missing_modality_and_labels_are_errors(spark):
    rows = spark.createDataFrame([(1, "t1"), (1, "t2"), (2, "t2"), (3, "flair")], "subject_id long, modality string")
    assert {r["subject_id"]: r["mode"] for r in L.modality_mode(rows, "null").collect()} == {1: "t1t2", 2: "t2", 3: None}
    with pytest.raises(Exception, match="subject 3"):
        L.modality_mode(rows).collect()
    sets = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.1)], "name string, vid long, value double")
    assert H.require_labels(sets, ["b"]).count() == 1
    with pytest.raises(ValueError, match="missing labels: \\['c'\\]"):
        H.require_labels(sets, ["a", "c"])


def test_offsets_round_as_stated(spark):
    rows = spark.range(1, 12).select(L.centre_offset(F.col("id"), 6).alias("c"), L.pad_offset(F.col("id"), 6).alias("p"), "id").collect()
    assert all(r["c"] == int((r["id"] - 6) / 2) and r["p"] == -((6 - r["id"]) // 2) for r in rows)


def test_volume_to_surface_fills_islands_and_keeps_halves(spark):
    """A flat 8 x 8 mesh one voxel below a volume of two halves, with one voxel of the left label in the right half."""
    n = 8
    vid = lambda i, j: i * n + j
    vertices = spark.createDataFrame([(1, vid(i, j), float(i), float(j), 1.0) for i in range(n) for j in range(n)], "subject_id long, vid long, x double, y double, z double")
    tri = [t for i in range(n - 1) for j in range(n - 1) for t in ((vid(i, j), vid(i + 1, j), vid(i, j + 1)), (vid(i + 1, j), vid(i + 1, j + 1), vid(i, j + 1)))]
    faces = spark.createDataFrame([(1, k, *t) for k, t in enumerate(tri)], "subject_id long, fid long, v0 long, v1 long, v2 long")
    seg = lambda i, j: 5 if j < 4 or (i, j) == (4, 6) else 9
    voxels = spark.createDataFrame([(1, i, j, 2, seg(i, j)) for i in range(n) for j in range(n)] + [(1, i, j, 1, 77) for i in range(n) for j in range(n)], "subject_id long, x int, y int, z int, seg int")
    identity = spark.createDataFrame([(1, [[float(r == c) for c in range(4)] for r in range(4)])], "subject_id long, m array<array<double>>")
    cortex = vertices.filter("vid <> 0").select("subject_id", "vid")
    got = {r["vid"]: r["label"] for r in H.volume_to_surface(vertices, faces, voxels, identity, cortex, depth=1.0).collect()}
    inner = {vid(i, j): (5 if j < 4 else 9) for i in range(1, n - 1) for j in range(1, n - 1) if j not in (3, 4)}
    assert all(got[v] == label for v, label in inner.items()) and got[vid(4, 6)] == 9

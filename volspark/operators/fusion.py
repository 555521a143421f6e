"""Fusing class scores of several viewing planes into one label per voxel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.plans.joins import literal_table

# Weight of each viewing plane.
PLANE_WEIGHTS = {"axial": 0.4, "coronal": 0.4, "sagittal": 0.2}


def fuse_scores(scores: DataFrame, weights: dict, plane: str = "plane", key: Sequence[str] = ("voxel",), s: str = "s") -> DataFrame:
    """Weighted sum of per-plane score arrays, one aggregate per class and no join between planes."""
    kind = dict(scores.dtypes)[plane]
    table = literal_table(scores.sparkSession, list(weights.items()), f"{plane} {kind}, _w double")
    rows = scores.join(table, plane).select(*key, "_w", F.posexplode(s).alias("c", "_s"))
    return rows.groupBy(*key, "c").agg(F.sum(F.col("_w") * F.col("_s")).alias("score"))


def fuse_arrays(scores: DataFrame, weights: dict, classes: int, plane: str = "plane", key: Sequence[str] = ("voxel",), s: str = "s") -> DataFrame:
    """Weighted sum per voxel as one array of ``classes`` scores.

    With the class count known each class is a column of one aggregate: planes combine before the single
    shuffle and no row is multiplied by the number of classes.
    """
    kind = dict(scores.dtypes)[plane]
    table = literal_table(scores.sparkSession, list(weights.items()), f"{plane} {kind}, _w double")
    rows = scores.join(table, plane)
    sums = [F.sum(F.col("_w") * F.col(s)[c]).alias(f"_{c}") for c in range(classes)]
    fused = rows.groupBy(*key).agg(*sums)
    return fused.select(*key, F.array(*(F.col(f"_{c}") for c in range(classes))).alias(s))


def hard_labels(fused: DataFrame, key: Sequence[str] = ("voxel",)) -> DataFrame:
    """Class of the highest score; of equal scores the lowest class."""
    best = F.max_by("c", F.struct("score", -F.col("c")))
    return fused.groupBy(*key).agg(best.alias("label"), F.max("score").alias("score"))


def argmax(scores: str) -> Column:
    """0-based position of the highest score of an array; of equal ones the first."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def clip_to_extent(voxels: DataFrame, extent: dict[str, int]) -> DataFrame:
    """Cut back to the original size after padding at the far end."""
    out = voxels
    for axis, n in extent.items():
        out = out.filter(F.col(axis) < n)
    return out

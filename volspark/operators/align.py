"""Fitting transforms to matched points: Spark adds up the moments, a small solve per pair does the rest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.operators.mesh import to_sphere
from volspark.operators.regions import SUBJECT

_P, _Q = ("px", "py", "pz"), ("qx", "qy", "qz")


def point_moments(pairs: DataFrame, by: Sequence[str] = (SUBJECT,)) -> DataFrame:
    """Count, sums and products of matched points p and q: all that the fits need."""
    names = [*_P, *_Q]
    sums = [F.sum(a).alias(f"s_{a}") for a in names]
    mixed = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in _P for b in (*_P, *_Q)]
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), *sums, *mixed)


def _moment_matrices(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    p = np.array([row[f"s_{a}"] for a in _P])
    q = np.array([row[f"s_{a}"] for a in _Q])
    pq = np.array([[row[f"{a}_{b}"] for b in _Q] for a in _P])
    pp = np.array([[row[f"{a}_{b}"] for b in _P] for a in _P])
    return p, q, pq, pp


def rotation_of(h: np.ndarray) -> np.ndarray:
    """Rotation that best turns p into q, given sum(p q^T); reflections are corrected."""
    u, _, vt = np.linalg.svd(h)
    if np.linalg.det(vt.T @ u.T) < 0:
        vt[2] = -vt[2]
    return vt.T @ u.T


def _solve(row, kind: str) -> np.ndarray:
    p, q, pq, pp = _moment_matrices(row)
    n = row["n"]
    m = np.eye(4)
    if kind == "rotation":
        m[:3, :3] = rotation_of(pq)
    elif kind == "rigid":
        m[:3, :3] = rotation_of(pq - np.outer(p, q) / n)
        m[:3, 3] = q / n - m[:3, :3] @ (p / n)
    else:
        normal = np.block([[pp, p[:, None]], [p[None, :], np.array([[n]])]])
        m[:3] = np.linalg.lstsq(normal, np.vstack([pq, q[None, :]]), rcond=None)[0].T
    return m


def half_way(m: np.ndarray) -> np.ndarray:
    """Principal square root by the coupled Newton iteration."""
    y, z = m.copy(), np.eye(len(m))
    for _ in range(60):
        y, z = (y + np.linalg.inv(z)) / 2, (z + np.linalg.inv(y)) / 2
    return y


def fit_transform(pairs: DataFrame, kind: str = "rigid", by: Sequence[str] = (SUBJECT,), half: bool = False) -> DataFrame:
    """4x4 matrix ``m`` per key that maps p to q: ``rotation`` (about the origin), ``rigid`` or ``affine``.

    The table that reaches Python has one row of moments per key.
    """
    if kind not in ("rotation", "rigid", "affine"):
        raise ValueError(f"unknown kind of transform {kind}")
    moments = point_moments(pairs, by)
    keys = list(by)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].copy()
            fitted = [_solve(row, kind) for row in batch.to_dict("records")]
            out["m"] = [(half_way(m) if half else m).tolist() for m in fitted]
            yield out

    types = dict(moments.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", m array<array<double>>"
    return moments.mapInPandas(solve, schema)


def matched_centroids(mov: DataFrame, dst: DataFrame, label: str = "seg", ids: Sequence[int] | None = None) -> DataFrame:
    """Centroids of the labels that both sides have (greater than 0 unless listed), as p and q."""

    def mean(df: DataFrame, names: Sequence[str]) -> DataFrame:
        rows = df.filter(F.col(label).isin(list(ids)) if ids is not None else F.col(label) > 0)
        return rows.groupBy(SUBJECT, label).agg(*(F.avg(a).alias(n) for a, n in zip("xyz", names, strict=True)))

    return mean(mov, _P).join(mean(dst, _Q), [SUBJECT, label])


def align_centroids(mov: DataFrame, dst: DataFrame, affine: bool = False, ids: Sequence[int] | None = None, label: str = "seg") -> DataFrame:
    return fit_transform(matched_centroids(mov, dst, label, ids), "affine" if affine else "rigid")


def align_spheres(mov: DataFrame, dst: DataFrame, ids: Sequence[int] | None = None, label: str = "label") -> DataFrame:
    """Rotation between label centroids that are put back on the sphere of radius 100."""
    pairs = matched_centroids(mov, dst, label, ids)
    return fit_transform(to_sphere(to_sphere(pairs, _P), _Q), "rotation")


def align_flipped(voxels: DataFrame, sides: DataFrame, dims: DataFrame, label: str = "seg") -> DataFrame:
    """Half-way transform (voxel space) that puts the mid plane of paired labels on the image's mid plane.

    ``sides`` pairs left and right ids (``src``, ``dst``); centroids are matched with those of the partner
    label mirrored about the middle of x.
    """
    both = sides.unionByName(sides.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    mid = voxels.groupBy(SUBJECT, F.col(label).alias("src")).agg(*(F.avg(a).alias(n) for a, n in zip("xyz", _P, strict=True)))
    partner = mid.select(SUBJECT, F.col("src").alias("dst"), *(F.col(p).alias(q) for p, q in zip(_P, _Q, strict=True)))
    pairs = mid.join(both, "src").join(partner, [SUBJECT, "dst"]).join(dims.select(SUBJECT, "nx"), SUBJECT)
    pairs = pairs.withColumn("qx", (F.col("nx") - 1.0) - F.col("qx"))
    return fit_transform(pairs, "rigid", half=True)

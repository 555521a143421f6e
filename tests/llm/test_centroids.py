"""Centroid clustering against plain rounds that measure every distance."""

import hashlib
import math

import numpy as np
import pytest

from volspark.llm.centroids import LARGEST, ns_clusters


def brute(rows, k=8, rounds=10, dims=64):
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) in Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * float(x)) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for now in range(rounds + 1):
        near = [min((gap(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
        if now == rounds:
            break
        for j in range(len(centres)):
            mine = [v for (_, v), (_, c) in zip(kept, near) if c == j]
            if mine:
                centres[j] = [sum(column) // len(mine) for column in zip(*mine)]
    of = lambda j: sum(d for d, c in near if c == j)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, c, d, of(c), of(0) + sum(of(j) for j in range(1, len(centres))), sha[c]) for (i, _), (d, c) in zip(kept, near)]


SCHEMA = "vec_id long, embedding array<float>, cluster string, _id string, v int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c", None, 7) for i, v in rows], SCHEMA)


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def clumps(n, dims=64, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.3, (12, dims))
    return [(i, np.float32(middle[rng.integers(12)] + rng.normal(0, 0.1, dims))) for i in range(n)]


def test_rounds_equal_brute_force_and_measure_less(spark):
    rows = clumps(3000)
    report = {}
    got = ns_clusters(table(spark, rows).repartition(7), report=report).collect()
    same(got, brute([(i, v.tolist()) for i, v in rows]))
    assert report[0] == 8 * 3000
    # after the first rounds most vectors stay by their bounds alone; the last one measures each own distance
    assert all(report[t] < 0.5 * 8 * 3000 for t in range(3, 11))


def test_ties_copies_nulls_and_broken_vectors(spark):
    grid = [(i, [float((i >> b) & 1) for b in range(2)] + [0.0] * 62) for i in range(40)]
    broken = [(50, None), (51, []), (52, [1.0] * 63), (53, [None] + [0.0] * 63), (54, [float("nan")] + [0.0] * 63), (55, [float("-inf")] + [0.0] * 63)]
    repeated = [(60, [0.5] * 64)] * 30 + [(60, [-0.25] * 64), (None, [2.0] * 64), (None, [2.0] * 64)]
    rows = grid + broken + repeated
    same(ns_clusters(table(spark, rows)).collect(), brute(rows))
    # one vector repeated in all rows: every centroid ties and the first takes all
    alike = [(i, [0.125] * 64) for i in range(30)]
    got = ns_clusters(table(spark, alike)).collect()
    same(got, brute(alike))
    assert {r["cluster"] for r in got} == {0}


def test_fewer_vectors_than_centroids_and_none(spark):
    few = [(1, [0.5] * 64), (2, [-0.5] * 64)]
    same(ns_clusters(table(spark, few)).collect(), brute(few))
    none = ns_clusters(table(spark, [(1, [0.5] * 3), (2, None)]))
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert none.count() == 0 and ns_clusters(table(spark, [])).count() == 0


def test_other_sizes_and_large_components(spark):
    rows = [(i, [float(i * i % 17), float(i % 5)]) for i in range(200)]
    same(ns_clusters(table(spark, rows), dims=2, k=5, rounds=4).collect(), brute(rows, 5, 4, 2))
    edge = [(i, [(LARGEST / 1024) * (-1) ** i] * 64) for i in range(20)]
    same(ns_clusters(table(spark, edge)).collect(), brute(edge))
    with pytest.raises(ValueError, match="beyond"):
        ns_clusters(table(spark, [(1, [1e30] * 64)]))

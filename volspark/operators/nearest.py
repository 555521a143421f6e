"""Exact nearest-neighbour join of points in space, without pairing whole groups.

Targets are cut into leaves of bounded size at quantiles of their own coordinates, key by key, so neither an outlier nor a
dense cluster makes a leaf large.  A query first meets the leaf it falls into, which bounds its distance, and then those
leaves whose boxes are no further than that.  Queries of a leaf meet its points in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.operators.regions import SUBJECT
from volspark.plans.joins import BROADCAST_ROWS, attach
from volspark.plans.storage import known_rows, materialize, measured, release

# Points of a leaf, parts a full box is cut into at once, and queries that meet a leaf in one group, at most.
LEAF_POINTS = 2048
PARTS = 16
CHUNK_QUERIES = 4096
# Rows with a list of up to PARTS boxes are broadcast only when there are that much fewer.
_WIDE_ROWS = BROADCAST_ROWS // PARTS
# Distances of boxes are compared with this much room for rounding.
_ROOM = 1 + 1e-9

_SIDES = [f"{s}{a}" for a in "xyz" for s in ("lo", "hi")]


def _sides() -> list[Column]:
    return [f(a).alias(f"{s}{a}") for a in "xyz" for s, f in (("lo", F.min), ("hi", F.max))]


def _bucket(cuts: str, axis: Column) -> Column:
    """How many cuts lie below the point's coordinate on the axis of the cut."""
    place = F.when(axis == 0, F.col("x")).when(axis == 1, F.col("y")).otherwise(F.col("z"))
    return F.size(F.filter(cuts, lambda c: c < place))


def _below(path: str, bucket: Column) -> Column:
    return F.concat(F.col(path), F.char(65 + bucket))


def _near2() -> Column:
    terms = []
    for a in "xyz":
        gap = F.greatest(F.lit(0.0), F.col(f"_b.lo{a}") - F.col(a), F.col(a) - F.col(f"_b.hi{a}"))
        terms.append(gap * gap)
    return terms[0] + terms[1] + terms[2]


def split_points(points: DataFrame, keys: Sequence[str], leaf_points: int = LEAF_POINTS) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Points with the path of their leaf, the leaves' boxes, and for each step the cuts of the boxes that were full.

    A full box is cut across its longest side at quantiles of its points, so every part holds at least one point; points
    differ, so a full box always has a part to cut off.
    """
    points = materialize(points.withColumn("path", F.lit("")), "points")
    steps = [i / PARTS for i in range(1, PARTS)]
    levels = []
    while True:
        quantiles = [F.percentile_approx(a, steps, 10 * PARTS).alias(f"_q{a}") for a in "xyz"]
        boxes, seen = measured(points.groupBy(*keys, "path").agg(F.count(F.lit(1)).alias("n"), *_sides(), *quantiles), "boxes", fullest=F.max("n"))
        if (seen["fullest"] or 0) <= leaf_points:
            return points, boxes.select(*keys, "path", *_SIDES), levels
        width = [F.col(f"hi{a}") - F.col(f"lo{a}") for a in "xyz"]
        longest = F.greatest(*width)
        axis = F.when(width[0] == longest, 0).when(width[1] == longest, 1).otherwise(2)
        pick = lambda name: F.when(F.col("axis") == 0, F.col(f"{name}x")).when(F.col("axis") == 1, F.col(f"{name}y")).otherwise(F.col(f"{name}z"))  # noqa: E731, B023
        full = boxes.filter(F.col("n") > leaf_points).withColumn("axis", axis)
        full = full.withColumns({"_lo": pick("lo"), "_hi": pick("hi"), "_q": pick("_q")})
        # no more parts than it takes: 2, 4, 8 or 16 of about half a leaf
        wanted = F.col("n") * 2 / leaf_points
        stride = F.when(wanted <= 2, 8).when(wanted <= 4, 4).when(wanted <= 8, 2).otherwise(1)
        some = F.filter("_q", lambda c, i: (i + 1) % stride == 0)
        cuts = F.filter(F.array_sort(F.array_distinct(some)), lambda c: c < F.col("_hi"))
        # more than a quantile's share at the upper end: cut in the middle, or right above the lower end
        middle = (F.col("_lo") + F.col("_hi")) / 2
        spare = F.array(F.when(middle < F.col("_hi"), middle).otherwise(F.col("_lo")))
        full = full.select(*keys, "path", "axis", F.when(F.size(cuts) > 0, cuts).otherwise(spare).alias("cuts"))
        levels.append(materialize(full, "cuts"))
        release(boxes)
        moved = attach(points, levels[-1], [*keys, "path"], max_rows=_WIDE_ROWS)
        path = F.when(F.col("cuts").isNull(), F.col("path")).otherwise(_below("path", _bucket("cuts", F.col("axis"))))
        moved = materialize(moved.withColumn("path", path).select(*points.columns), "points")
        release(points)
        points = moved


def _closest(pairs: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, qid, d2, tid: the closest point of each pair of a query and a leaf (``path``), of equal ones the smallest tid.

    The queries of a leaf are dealt to chunks; a chunk meets a copy of the leaf's points, so copies add up to no more than
    a share of the queries.
    """
    at = [*keys, "path"]
    if known_rows(pairs) is None:
        pairs = materialize(pairs, "asked")
    chunks = pairs.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / CHUNK_QUERIES).cast("int").alias("_chunks"))
    chunks = materialize(chunks, "chunks")
    asked = attach(pairs, chunks, at, "inner").withColumn("_chunk", F.pmod(F.xxhash64("qid"), F.col("_chunks")).cast("int"))
    met = attach(points, chunks, at, "inner").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    group = [*at, "_chunk"]
    asked, met = asked.select(*group, "qid", "x", "y", "z"), met.select(*group, "tid", "x", "y", "z")
    kinds = {f.name: f.dataType.simpleString() for f in [*asked.schema, *met.schema]}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "qid")) + f", d2 double, tid {kinds['tid']}"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("tid")
        q, p = ([t.column(a).to_numpy() for a in "xyz"] for t in (left, right))
        n, m = len(left), len(right)
        best, d2 = np.zeros(n, np.int64), np.full(n, np.inf)
        step = max(1, (1 << 18) // max(m, 1))
        for start in range(0, n if m else 0, step):
            part = slice(start, start + step)
            gap = np.zeros((len(q[0][part]), m))
            for a in range(3):
                gap += (q[a][part, None] - p[a][None]) ** 2
            best[part] = gap.argmin(1)
            d2[part] = gap[np.arange(len(gap)), best[part]]
        left = left.select([*keys, "qid"])
        if not m:
            left, d2, best = left.slice(0, 0), d2[:0], best[:0]
        return left.append_column("d2", pa.array(d2)).append_column("tid", pc.take(right.column("tid"), pa.array(best)))

    return asked.groupBy(*group).cogroup(met.groupBy(*group)).applyInArrow(run, schema)


def nearest_points(queries: DataFrame, targets: DataFrame, keys: Sequence[str] = (SUBJECT,), leaf_points: int = LEAF_POINTS) -> DataFrame:
    """Nearest target of each query: ``keys, qid, tid, distance``; of equal distances the smallest ``tid``.

    ``queries`` have ``qid`` (unique within the keys), ``targets`` have ``tid``; both have x, y, z.
    Queries whose keys have no target have NULL ``tid`` and ``distance``.
    """
    keys = list(keys)
    coords = [F.col(a).cast("double").alias(a) for a in "xyz"]
    points = targets.select(*keys, "tid", *coords).groupBy(*keys, "x", "y", "z").agg(F.min("tid").alias("tid"))
    points, leaves, levels = split_points(points, keys, leaf_points)

    asked = queries.select(*keys, "qid", *coords).withColumn("path", F.lit(""))
    for cuts in levels:
        asked = attach(asked, cuts, [*keys, "path"], max_rows=_WIDE_ROWS)
        path = F.when(F.col("cuts").isNull(), F.col("path")).otherwise(_below("path", _bucket("cuts", F.col("axis"))))
        asked = asked.withColumn("path", path).drop("axis", "cuts")
    if levels:
        asked = materialize(asked, "asked")
    found = _closest(asked, points, keys)
    if levels:
        found = materialize(found, "first")
        others = _other_leaves(asked, found, leaves, keys, len(levels))
        found = found.unionByName(_closest(others, points, keys))
        found = found.groupBy(*keys, "qid").agg(F.min(F.struct("d2", "tid")).alias("_m")).select(*keys, "qid", "_m.*")
    return queries.select(*keys, "qid").join(found, [*keys, "qid"], "left").select(*keys, "qid", "tid", F.sqrt("d2").alias("distance"))


def _other_leaves(asked: DataFrame, found: DataFrame, leaves: DataFrame, keys: Sequence[str], depth: int) -> DataFrame:
    """Pairs of a query and a leaf, other than its own, whose box is no further than what the query has found."""
    upto = F.explode(F.sequence(F.lit(1), F.length("path"))).alias("_k")
    inner = leaves.filter("path <> ''").select("*", upto).withColumn("_node", F.expr("substring(path, 1, _k)"))
    merged = [(F.min if s.startswith("lo") else F.max)(s).alias(s) for s in _SIDES]
    nodes = inner.groupBy(*keys, "_node").agg(F.bool_or(F.col("path") == F.col("_node")).alias("leaf"), *merged)
    parent = F.expr("substring(_node, 1, length(_node) - 1)")
    children = nodes.groupBy(*keys, parent.alias("_at")).agg(F.collect_list(F.struct("_node", "leaf", *_SIDES)).alias("_children"))
    children = materialize(children, "children")
    bound = found.select(*keys, "qid", (F.col("d2") * _ROOM).alias("_limit"))
    kept = asked.join(bound, [*keys, "qid"]).withColumnRenamed("path", "_own").withColumn("_at", F.lit(""))
    done = []
    for _ in range(depth):
        opened = attach(kept, children, [*keys, "_at"], "inner", max_rows=_WIDE_ROWS)
        opened = opened.select(*keys, "qid", "x", "y", "z", "_limit", "_own", F.explode("_children").alias("_b"))
        opened = materialize(opened.filter((_near2() <= F.col("_limit")) & (F.col("_b._node") != F.col("_own"))), "descent")
        done.append(opened.filter("_b.leaf").select(*keys, "qid", "x", "y", "z", F.col("_b._node").alias("path")))
        kept = opened.filter("NOT _b.leaf").select(*keys, "qid", "x", "y", "z", "_limit", "_own", F.col("_b._node").alias("_at"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out

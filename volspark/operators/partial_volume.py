"""Partial-volume fractions of boundary voxels and the label volumes that follow from them.

A boundary voxel may hold two tissues.  Its own label and one neighbouring label, whose mean intensities
nearby lie on either side of the voxel's intensity, share it in proportion.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.operators.blocks import Block, box_sums, map_voxels
from volspark.operators.grid import neighbours
from volspark.operators.labels import VOXEL
from volspark.operators.regions import SUBJECT, is_in
from volspark.plans.joins import attach
from volspark.plans.storage import materialize

EPS = 1e-6
WINDOW = 15
# Blocks are larger here, as the halo is seven voxels wide.
PV_SIDE = 64
# Decimals kept of local means and of local label frequencies before they are compared.
MEAN_DECIMALS = 10
FREQUENCY_DECIMALS = 6


def boundary_neighbourhoods(voxels: DataFrame, guide: str = "norm", labels: Sequence[int] | None = None, side: int = PV_SIDE) -> DataFrame:
    """Boundary voxels (6 neighbours) of the wanted labels, on either side of it: own label, ``pv``, and ``near``, one entry
    for each label c of its 3x3x3 window with the voxels and the sum of c in the 15x15x15 window.

    ``face`` tells whether c lies at the voxel or a face neighbour.  Voxels meet in blocks with a halo of seven; a block
    without a boundary ends there, and a label's box sums cover no more than its boundary voxels and their windows.
    """
    wanted = F.col("seg") if labels is None else F.when(is_in("seg", labels), F.col("seg")).otherwise(-1)
    rows = voxels.select(*VOXEL, "seg", wanted.cast("int").alias("_wanted"), F.col(guide).cast("double").alias("pv"))
    reach = WINDOW // 2
    faces = [(0, 0, 0), *neighbours(6)]
    window = [*faces, *(o for o in neighbours(26) if o not in faces)]
    near_type = pa.list_(pa.struct([("c", pa.int32()), ("n", pa.int64()), ("total", pa.float64()), ("face", pa.int32())]))

    def compute(block: Block):
        own = block.at("_wanted")
        edge = np.zeros(own.shape, bool)
        for o in faces:
            edge |= block.here(o) & (block.at("_wanted", o) != own)
        edge &= block.here()

        def near(at: tuple[np.ndarray, ...]) -> pa.Array:
            n = len(at[0])
            seen = np.stack([block.at("seg", o)[at] for o in window]) if n else np.zeros((0, 0))
            there = np.stack([block.here(o)[at] for o in window]) if n else np.zeros((0, 0), bool)
            seg, value, filled = block.whole("seg"), block.whole("pv"), block.whole()
            parts = []
            for c in np.unique(seen[there]):
                found = (seen == c) & there
                which = np.flatnonzero(found.any(0))
                # positions of the window's lowest corner in the array with the halo are those of the voxel in the inside
                low = [int(i[which].min()) for i in at]
                box = tuple(slice(lo, int(i[which].max()) + 2 * reach + 1) for lo, i in zip(low, at, strict=True))
                mine = filled[box] & (seg[box] == c)
                inside = tuple(i[which] - lo for i, lo in zip(at, low, strict=True))
                count = box_sums(mine.astype(np.int64), WINDOW)[inside]
                total = box_sums(np.where(mine, value[box], 0.0), WINDOW)[inside]
                parts.append((which, np.full(len(which), c), count, total, found[: len(faces), which].any(0)))
            if not parts:
                return pa.array([[]] * n, near_type)
            which, c, count, total, face = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(which, kind="stable")
            entries = pa.StructArray.from_arrays(
                [pa.array(v[order]).cast(f.type) for v, f in zip((c, count, total, face.astype(np.int32)), near_type.value_type, strict=True)],
                fields=list(near_type.value_type),
            )
            ends = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=n))])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries, type=near_type)

        return edge, {"near": near}

    out = map_voxels(rows, reach, ["seg", "_wanted", "pv"], compute, "near array<struct<c:int,n:bigint,total:double,face:int>>", ["seg", "pv"], side=side)
    return out.withColumnRenamed("seg", "own")


def partial_volume_maps(
    voxels: DataFrame, dims: DataFrame, guide: str = "norm", labels: Sequence[int] | None = None, legacy: bool = False
) -> DataFrame:
    """Per boundary voxel: mixing label ``nbr``, local means, own share ``mix`` and the other's ``nbr_mix``.

    Of the valid labels the one most frequent in the 15x15x15 window is chosen, of equal ones the
    smallest.  Without a valid label the voxel is all its own.  ``legacy`` drops the other share unless
    the voxel touches the chosen label by a face.
    """
    edge = boundary_neighbourhoods(voxels, guide, labels)
    pv, own = F.col("pv"), F.col("seg_mean")
    known = F.transform(
        "near",
        lambda e: F.struct(
            F.round(e["n"] / WINDOW**3, FREQUENCY_DECIMALS).alias("freq"), (-e["c"]).alias("order"),
            F.round(e["total"] / e["n"], MEAN_DECIMALS).alias("mean"), e["face"].alias("face"),
        ),
    )
    edge = edge.select(*VOXEL, F.col("own").alias("seg"), "pv", known.alias("_near"))
    edge = edge.withColumn("seg_mean", F.filter("_near", lambda e: -e["order"] == F.col("seg"))[0]["mean"])
    valid = lambda e: (
        (-e["order"] != F.col("seg")) & ((e["mean"] > pv) != (own > pv)) & (e["mean"] != pv) & (F.abs(own - pv) > EPS)
    )
    chosen = edge.withColumn("_best", F.array_max(F.filter("_near", valid)))
    apart = own - F.col("_best.mean")
    share = F.when(F.col("_best").isNull() | (F.abs(apart) <= EPS), 1.0).otherwise(
        F.least(F.greatest((pv - F.col("_best.mean")) / apart, F.lit(0.0)), F.lit(1.0))
    )
    out = chosen.withColumn("mix", share)
    rest = 1.0 - F.col("mix")
    if legacy:
        rest = F.when(F.col("_best.face") == 1, rest).otherwise(0.0)
    nbr = F.coalesce(-F.col("_best.order"), F.lit(0)).cast("int")
    return out.select(
        *VOXEL, "seg", nbr.alias("nbr"), "seg_mean", F.coalesce("_best.mean", F.lit(0.0)).alias("nbr_mean"), "mix", rest.alias("nbr_mix")
    )


def partial_volume_volumes(
    voxels: DataFrame,
    dims: DataFrame,
    headers: DataFrame,
    guide: str = "norm",
    labels: Sequence[int] | None = None,
    legacy: bool = False,
    maps: DataFrame | None = None,
) -> DataFrame:
    """Volume per label: whole voxels away from boundaries plus the shares of boundary voxels."""
    maps = maps if maps is not None else materialize(partial_volume_maps(voxels, dims, guide, labels, legacy), "mixing")
    counts = voxels.groupBy(SUBJECT, "seg").agg(F.count(F.lit(1)).alias("_n"))
    shares = maps.select(
        SUBJECT,
        F.explode(
            F.array(
                F.struct(F.col("seg").alias("seg"), (F.col("mix") - 1.0).alias("v")),
                F.struct(F.col("nbr").alias("seg"), F.col("nbr_mix").alias("v")),
            )
        ).alias("s"),
    )
    added = shares.groupBy(SUBJECT, F.col("s.seg").alias("seg")).agg(F.sum("s.v").alias("_added"))
    present = counts if labels is None else counts.filter(is_in("seg", labels))
    out = present.join(added, [SUBJECT, "seg"], "left").fillna(0.0, subset=["_added"])
    sized = attach(out, headers.select(SUBJECT, "vox_vol"), SUBJECT, costly=False)
    return sized.select(SUBJECT, "seg", ((F.col("_n") + F.col("_added")) * F.col("vox_vol")).alias("volume"))

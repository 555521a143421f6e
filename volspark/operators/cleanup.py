"""Clean-up of segmentations built from morphology, components, blurs and nearest labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.operators.blocks import Block, box_sums, map_voxels
from volspark.operators.components import drop_small, in_largest_grown, keep_largest, split_largest, voxel_components
from volspark.operators.grid import dilate, erode, gaussian
from volspark.operators.labels import VOXEL
from volspark.operators.nearest import nearest_points
from volspark.operators.regions import SUBJECT, is_in, not_in
from volspark.plans.joins import attach
from volspark.plans.storage import materialize, measured

# Frontal parcels that are put back into the brain mask untouched.
FRONTAL = [2012, 1012, 2019, 1019]
# White and gray matter of the two sides.
LEFT_WHITE, LEFT_GRAY, RIGHT_WHITE, RIGHT_GRAY = 2, 3, 41, 42
# Parcels that exist once for both sides, and those among them decided by blurred white matter.
UNSIDED_PARCELS = [
    1003, 1006, 1007, 1008, 1009, 1011, 1015, 1018, 1019, 1020, 1025, 1026, 1027, 1028, 1029, 1030, 1031, 1034, 1035,
]
BLUR_DECIDED = [1011, 1019, 1026, 1029]
# Optic labels, and labels left out of the cleaned result.
OPTIC = [1, 2, 4, 5]
NOT_REPORTED = [13, 20]
# Cerebellum part labels that may fill holes.
FILL_LABELS = [*range(1, 9), *range(10, 29), 37, 38]


def brain_mask(voxels: DataFrame, dims: DataFrame, grow: int = 5, shrink: int = 4, label: str = "seg", apart: Sequence[int] = FRONTAL) -> DataFrame:
    """Labelled voxels grown and shrunk, largest component only, with the frontal parcels added back."""
    body = voxels.filter((F.col(label) > 0) & not_in(label, apart)).select(*VOXEL)
    smooth = erode(dilate(body, dims, 26, grow), dims, 26, shrink)
    frontal = voxels.filter(is_in(label, apart)).select(*VOXEL)
    return keep_largest(smooth, 26).unionByName(frontal).distinct()


def _signed_blur(voxels: DataFrame, dims: DataFrame, left: Sequence[int], right: Sequence[int], sigma: float, mode: str, label: str) -> DataFrame:
    """Blurred right-minus-left field."""
    signed = voxels.filter(is_in(label, [*left, *right])).select(*VOXEL, F.when(is_in(label, left), -1.0).otherwise(1.0).alias("_s"))
    return gaussian(signed, dims, {"field": "_s"}, sigma, mode)


def flip_islands(voxels: DataFrame, dims: DataFrame, label: str = "seg", sides=((LEFT_WHITE, LEFT_GRAY), (RIGHT_WHITE, RIGHT_GRAY)), sigma: float = 1.5) -> DataFrame:
    """White-matter islands apart from their side's main body go to the side that surrounds them."""
    (lw, lg), (rw, rg) = sides
    white = voxels.filter(is_in(label, [lw, rw])).select(*VOXEL, label)
    islands = split_largest(white, 26, [label]).filter(~F.col("largest")).select(*VOXEL, F.lit(True).alias("_island"))
    field = _signed_blur(voxels, dims, [lw, lg], [rw, rg], sigma, "nearest", label)
    placed = islands.join(field, VOXEL, "left").fillna(0.0, subset=["field"])
    out = voxels.join(placed, VOXEL, "left")
    flipped = (
        F.when(F.col("_island") & (F.col(label) == rw) & (F.col("field") < 0), lw)
        .when(F.col("_island") & (F.col(label) == lw) & (F.col("field") > 0), rw)
        .otherwise(F.col(label))
    )
    return out.withColumn(label, flipped.cast("int")).drop("_island", "field")


def clean_regions(voxels: DataFrame, dims: DataFrame, label: str = "seg", optic: Sequence[int] = OPTIC, reach: tuple[int, int] = (7, 5)) -> DataFrame:
    """Drop parts far from the main body (optic labels and the rest on their own), then specks of up to 3 voxels."""
    parts = []
    for chosen, steps in ((is_in(label, optic), reach[0]), (not_in(label, [0, *optic]), reach[1])):
        part = voxels.filter(chosen).select(*VOXEL, label)
        body = in_largest_grown(part, dims, steps)
        parts.append(part.join(body, VOXEL, "left_semi").filter(not_in(label, NOT_REPORTED)))
    cleaned = materialize(parts[0].unionByName(parts[1]), "cleaned")
    return cleaned.join(drop_small(cleaned.select(*VOXEL), 3, 26), VOXEL, "left_semi")


def fill_by_blur(voxels: DataFrame, dims: DataFrame, unknown: int, stop: int, sigma: float = 5.0, label: str = "seg") -> DataFrame:
    """An unknown label takes the neighbouring parcel in ``(unknown, stop)`` that is strongest after blurring.

    Only parcels that touch the unknown region compete; of equal ones the lowest wins.
    """
    hole = voxels.filter(F.col(label) == unknown).select(*VOXEL)
    ring = dilate(hole, dims, 18, 1)
    touching = voxels.join(ring, VOXEL, "left_semi").filter((F.col(label) > unknown) & (F.col(label) < stop))
    parcels = materialize(touching.select(SUBJECT, label).distinct(), "parcels")
    rivals = attach(voxels.select(*VOXEL, label), parcels, [SUBJECT, label], "inner", costly=False)
    blurred = gaussian(rivals.withColumn("_one", F.lit(1.0)), dims, {"_v": "_one"}, sigma, "reflect", extra=[label])
    seen = hole.join(blurred.withColumn("_v", F.round("_v", 12)), VOXEL)
    best = seen.groupBy(*VOXEL).agg(F.max_by(label, F.struct("_v", -F.col(label))).alias("_fill"))
    first = parcels.groupBy(SUBJECT).agg(F.min(label).alias("_first"))
    out = attach(voxels.join(best, VOXEL, "left"), first, SUBJECT)
    filled = F.when(F.col(label) == unknown, F.coalesce("_fill", "_first", label)).otherwise(F.col(label))
    return out.withColumn(label, filled.cast("int")).drop("_fill", "_first")


# Distance up to which holes are filled inside blocks, in whole voxels; see :func:`fill_by_distance`.
NEAR = 4


def _shells(reach: int) -> list[np.ndarray]:
    """Offsets by their distance in whole voxels, 0 to ``reach``."""
    offsets = np.stack(np.meshgrid(*[np.arange(-reach, reach + 1)] * 3, indexing="ij"), -1).reshape(-1, 3)
    whole = np.floor(np.sqrt((offsets**2).sum(1)))
    return [offsets[whole == d] for d in range(reach + 1)]


def _fill(voxels: DataFrame, marks: dict[str, Column], hole: Callable[[Block], np.ndarray], candidates: Sequence[int], label: str) -> DataFrame:
    """:func:`fill_by_distance` for holes that ``hole`` marks in a block with the columns ``marks``; written."""
    rank = F.coalesce(F.array_position(F.lit(list(candidates)).cast("array<int>"), F.col(label).cast("int")), F.lit(0)).cast("int")
    marked = voxels.withColumns({**{n: F.coalesce(c, F.lit(False)).cast("int") for n, c in marks.items()}, "_rank": rank})
    shells = _shells(NEAR)

    def compute(block: Block) -> tuple[np.ndarray, dict]:
        here, ranks = block.here(), block.whole("_rank")
        own = np.zeros(here.shape, bool)
        own[tuple(i[block.own] for i in block.rows)] = True
        left = np.argwhere(hole(block) & here & own)
        picked = np.zeros(here.shape, np.int32)
        for offsets in shells:
            near = []
            for part in np.array_split(left, len(left) // 4096 + 1):
                at = part[:, None] + (offsets + NEAR)
                found = ranks[at[..., 0], at[..., 1], at[..., 2]]
                near.append(np.where(found > 0, found, len(candidates) + 1).min(1))
            near = np.concatenate(near)
            found = near <= len(candidates)
            picked[tuple(left[found].T)] = near[found]
            left = left[~found]
        rest = np.zeros(here.shape, bool)
        rest[tuple(left.T)] = True
        return here, {"_pick": picked, "_rest": rest}

    filled = map_voxels(marked, NEAR, [*marks, "_rank"], compute, "_pick int, _rest boolean", [*voxels.columns, "_rank"])
    pick = F.element_at(F.lit(list(candidates)).cast("array<int>"), F.nullif("_pick", F.lit(0)))
    filled = filled.withColumn(label, F.coalesce(pick, F.col(label)).cast("int")).drop("_pick")
    filled, seen = measured(filled, "filled", rest=F.count_if("_rest"))
    if not seen["rest"]:
        return filled.select(*voxels.columns)
    place = F.shiftleft(F.col("x").cast("long"), 40) + F.shiftleft(F.col("y").cast("long"), 20) + F.col("z")
    sources = filled.filter("_rank > 0").select(SUBJECT, F.col("_rank").alias("_c"), place.alias("tid"), "x", "y", "z")
    present = sources.select(SUBJECT, "_c").distinct().groupBy(SUBJECT).agg(F.collect_list("_c").alias("_all"))
    asked = attach(filled.filter("_rest").select(*VOXEL), present, SUBJECT, "inner").select(*VOXEL, place.alias("qid"), F.explode("_all").alias("_c"))
    found = nearest_points(asked, sources, [SUBJECT, "_c"])
    best = found.groupBy(SUBJECT, "qid").agg(F.min(F.struct(F.floor("distance"), "_c"))["_c"].alias("_best"))
    out = filled.withColumn("qid", F.when(F.col("_rest"), place)).join(best, [SUBJECT, "qid"], "left")
    far = F.element_at(F.lit(list(candidates)).cast("array<int>"), F.col("_best"))
    return materialize(out.withColumn(label, F.coalesce(far, F.col(label)).cast("int")).select(*voxels.columns), "filled")


def fill_by_distance(voxels: DataFrame, holes: DataFrame, candidates: Sequence[int], label: str = "seg") -> DataFrame:
    """Holes take the candidate label that is nearest in whole voxels; of equal ones the first listed.

    Holes with a candidate nearer than ``NEAR + 1`` voxels are filled inside blocks, where nothing that lies beyond can win;
    the others meet the nearest voxel of every candidate of their subject.
    """
    marked = voxels.join(holes.select(*VOXEL, F.lit(True).alias("_is_hole")), VOXEL, "left")
    return _fill(marked, {"_hole": F.col("_is_hole")}, lambda block: block.at("_hole") > 0, candidates, label).select(*voxels.columns)


def split_parcels(
    voxels: DataFrame, dims: DataFrame, label: str = "seg", parcels: Sequence[int] = UNSIDED_PARCELS, by_blur: Sequence[int] = BLUR_DECIDED,
    white: tuple[int, int] = (LEFT_WHITE, RIGHT_WHITE), shift: int = 1000, sigma: float = 3.0,
) -> DataFrame:
    """Give unsided parcels a side: right parcels are ``parcel + shift``.

    Each component goes to the side whose white-matter centroid is nearer; a few parcels are then decided
    voxel by voxel by which side's blurred white matter is stronger (left if equal).
    """
    lw, rw = white
    body = keep_largest(voxels.filter(is_in(label, [lw, rw])).select(*VOXEL, label), 26, [label])
    mid = body.groupBy(SUBJECT).agg(
        *(F.avg(F.when(F.col(label) == w, F.col(a))).alias(f"_{s}{a}") for w, s in ((lw, "l"), (rw, "r")) for a in "xyz")
    )
    mask = voxels.filter(is_in(label, parcels)).select(*VOXEL, label)
    found = materialize(voxel_components(mask, 26, [label]), "components")
    centre = found.groupBy(SUBJECT, label, "component").agg(*(F.avg(a).alias(f"_c{a}") for a in "xyz"))
    placed = attach(centre, mid, SUBJECT)

    def far(s):
        return sum(((F.col(f"_c{a}") - F.col(f"_{s}{a}")) ** 2 for a in "xyz"), F.lit(0.0))

    right = placed.filter(far("r") < far("l")).select(SUBJECT, label, "component")
    moved = attach(found, right, [SUBJECT, label, "component"], "inner").select(*VOXEL, F.lit(True).alias("_right"))
    out = voxels.join(moved, VOXEL, "left").withColumn(label, F.when(F.col("_right"), F.col(label) + shift).otherwise(F.col(label)).cast("int")).drop("_right")

    field = _signed_blur(voxels, dims, [lw], [rw], sigma, "reflect", label)
    out = out.join(field.withColumn("field", F.round("field", 12)), VOXEL, "left").fillna(0.0, subset=["field"])
    base = F.when(is_in(label, [p + shift for p in by_blur]), F.col(label) - shift).otherwise(F.col(label))
    decided = F.when(is_in(label, [q for p in by_blur for q in (p, p + shift)]), base + F.when(F.col("field") > 0, shift).otherwise(0))
    return out.withColumn(label, F.coalesce(decided, F.col(label)).cast("int")).drop("field")


def merge_cerebellum(voxels: DataFrame, dims: DataFrame, manual: bool = False, part: str = "part", whole: str = "seg") -> DataFrame:
    """Combine cerebellum part labels with white matter of a whole-brain segmentation and fill the gaps.

    White matter (7 and 46 of ``whole``) becomes 37 and 38; parts 29..34 become 36; voxels beside white
    matter and cortex, and labels 9 and 36, are refilled by the nearest label; small pieces of each label
    are dropped.  Returns the voxels with new ``part`` and, for manual parts, updated ``whole``.
    """
    seg, old = F.col(whole), F.col(part)
    cortex = (old != 0) if manual else seg.isin(8, 47)
    start = F.when(seg == 7, 37).when(seg == 46, 38).when(cortex, F.when(old.between(29, 34), 36).otherwise(old)).otherwise(0)
    work = voxels.select(*VOXEL, whole, F.col(part).alias("_old"), cortex.alias("_cortex"), start.cast("int").alias(part))
    sized = attach(work, dims.select(SUBJECT, "nx", "ny", "nz"), SUBJECT, costly=False)
    within = F.lit(True)
    for a in "xyz":
        within = within & F.col(a).between(0, F.col(f"n{a}") - 1)
    marks = {"_white": F.col(part).isin(37, 38), "_gray": F.col("_cortex"), "_within": within, "_again": F.col(part).isin(9, 36)}

    def hole(block: Block) -> np.ndarray:
        touching = block.at("_within") > 0
        for name in ("_white", "_gray"):
            grown = box_sums(block.whole(name).astype(np.int16), 3) > 0
            inner = tuple(slice(NEAR - 1, NEAR - 1 + n) for n in touching.shape)
            touching = touching & grown[inner] & (block.at(name) == 0)
        return touching | (block.at("_again") > 0)

    filled = _fill(sized, marks, hole, [37, 38] if manual else FILL_LABELS, part).select(*work.columns)
    main = split_largest(filled.filter(F.col(part) != 0).select(*VOXEL, part), 26, [part]).filter("largest").select(*VOXEL)
    kept = filled.join(main.withColumn("_main", F.lit(True)), VOXEL, "left")
    kept = kept.withColumn(part, F.when(F.col("_main"), F.col(part)).otherwise(0).cast("int")).drop("_main")
    again = (F.col(part) != 0) & not_in(part, FILL_LABELS)
    out, seen = measured(kept, "kept", again=F.count_if(again))
    if seen["again"]:
        out = _fill(out, {"_again": again}, lambda block: block.at("_again") > 0, FILL_LABELS, part)
    if not manual:
        final = F.when(seg == 7, 37).when(seg == 46, 38).otherwise(F.col(part))
        return out.withColumn(part, final.cast("int")).drop("_old", "_cortex")
    out = out.withColumn(part, F.when(F.col("_cortex"), F.col("_old")).otherwise(F.col(part)).cast("int"))
    updated = (
        F.when(F.col(part) == 37, 7).when(F.col(part) == 38, 46).when(F.col(part) != 0, 8).when(seg.isin(8, 47), 0).otherwise(seg)
    )
    return out.withColumn(whole, updated.cast("int")).drop("_old", "_cortex")

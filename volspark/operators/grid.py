"""Neighbourhood operators on voxel grids.

Small neighbourhoods: blocks with a halo (:mod:`volspark.operators.blocks`), so only voxels next to a block's face are
sent twice and no join is needed.  Wide kernels: one pass per axis over whole image lines, whose length is bounded by the
image size.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.functions.lines import box_weights, gaussian_weights, line_filter
from volspark.operators.blocks import Block, box_sums, map_cells, map_voxels
from volspark.operators.labels import VOXEL
from volspark.operators.regions import SUBJECT, is_in, not_in
from volspark.plans.joins import attach
from volspark.plans.storage import materialize

Offset = tuple[int, int, int]
_MAX_STEPS = {6: 1, 18: 2, 26: 3}


def neighbours(connectivity: int, reach: int = 1) -> list[Offset]:
    """Offsets of a 6-, 18- or 26-neighbourhood applied ``reach`` times, without the centre."""
    steps = _MAX_STEPS[connectivity]
    side = range(-reach, reach + 1)
    inside = [o for o in product(side, repeat=3) if sum(map(abs, o)) <= steps * reach]
    return [o for o in inside if o != (0, 0, 0)]


def send(voxels: DataFrame, offsets: Sequence[Offset]) -> DataFrame:
    """One row per voxel and offset, at the shifted position; ``_k`` is the offset's number."""
    shifts = F.array(
        *(F.struct(*(F.lit(v).alias(f"_d{a}") for v, a in zip(o, "xyz", strict=True)), F.lit(k).alias("_k")) for k, o in enumerate(offsets))
    )
    rows = voxels.withColumn("_o", F.explode(shifts))
    for a in "xyz":
        rows = rows.withColumn(a, F.col(a) + F.col(f"_o._d{a}"))
    return rows.withColumn("_k", F.col("_o._k")).drop("_o")


def borders(voxels: DataFrame, label: str = "seg", connectivity: int = 6, keep: Sequence[str] = (), outside: str = "ignore") -> DataFrame:
    """Add ``border``: some neighbour has another label, which marks both sides of a boundary.

    Beyond the image nothing differs (``ignore``), or everything counts as label 0 (``zero``).
    """
    offsets = neighbours(connectivity)

    def compute(block: Block):
        own = block.at(label)
        differs, missing = np.zeros(own.shape, bool), np.zeros(own.shape, bool)
        for o in offsets:
            there = block.here(o)
            differs |= there & (block.at(label, o) != own)
            missing |= ~there
        if outside == "zero":
            differs |= missing & (own != 0)
        return block.here(), {"border": differs}

    return map_voxels(voxels, 1, [label], compute, "border boolean", [label, *keep])


def label_borders(voxels: DataFrame, wanted: int, label: str = "seg", connectivity: int = 6) -> DataFrame:
    """Border voxels of one label, on both sides of its boundary."""
    binary = voxels.select(*VOXEL, (F.col(label) == wanted).cast("int").alias("_is"))
    return borders(binary, "_is", connectivity).filter("border").select(*VOXEL, (F.col("_is") == 1).alias("inside"))


def multi_label_borders(voxels: DataFrame, wanted: Sequence[int], label: str = "seg", connectivity: int = 6) -> DataFrame:
    """Borders between the wanted labels and anything else, with label 0 beyond the image."""
    merged = voxels.withColumn(label, F.when(is_in(label, wanted), F.col(label)).otherwise(0))
    return borders(merged, label, connectivity, outside="zero").filter("border").select(*VOXEL, label)


# --- binary morphology -------------------------------------------------------------------------------


def _inside(rows: DataFrame) -> DataFrame:
    for a in "xyz":
        rows = rows.filter((F.col(a) >= 0) & (F.col(a) < F.col(f"n{a}")))
    return rows


def with_dims(rows: DataFrame, dims: DataFrame) -> DataFrame:
    return attach(rows, dims.select(SUBJECT, "nx", "ny", "nz"), SUBJECT, "inner", costly=False)


def inside(rows: DataFrame, dims: DataFrame) -> DataFrame:
    """Rows within the sizes of ``dims``, which may be those of the stored part of an image."""
    return _inside(with_dims(rows, dims)).select(*rows.columns)


# Steps of the 26-neighbourhood that are done inside blocks; more go along whole lines, axis by axis.
BLOCK_STEPS = 8


def _box_counts(mask: DataFrame, dims: DataFrame, reach: int, extra: Sequence[str]) -> DataFrame:
    ones = mask.select(*VOXEL, *extra).withColumn("_c", F.lit(1.0))
    return convolve(ones, dims, {"_c": "_c"}, box_weights(reach), "constant", extra=extra)


def dilate(mask: DataFrame, dims: DataFrame, connectivity: int = 26, iterations: int = 1, extra: Sequence[str] = ()) -> DataFrame:
    """Grow a mask (one row per voxel), clipped to the image.

    ``iterations`` steps of the 26-neighbourhood are one box; those of the smaller ones are one ball of offsets.
    """
    if connectivity == 26 and iterations > BLOCK_STEPS:
        return _box_counts(mask, dims, iterations, extra).select(*VOXEL, *extra)
    offsets = neighbours(connectivity, iterations) if connectivity != 26 else []

    def compute(block: Block) -> np.ndarray:
        if connectivity == 26:
            return box_sums(block.whole().astype(np.int16), 2 * iterations + 1) > 0
        grown = block.here().copy()
        for o in offsets:
            grown |= block.here(o)
        return grown

    grown = map_cells(mask, iterations, compute, extra)
    return _inside(with_dims(grown, dims)).select(*VOXEL, *extra)


def erode(mask: DataFrame, dims: DataFrame, connectivity: int = 26, iterations: int = 1, extra: Sequence[str] = ()) -> DataFrame:
    """Shrink a mask; beyond the image counts as outside, so voxels at the image edge go."""
    full = (2 * iterations + 1) ** 3
    if connectivity == 26 and iterations > BLOCK_STEPS:
        return _box_counts(mask, dims, iterations, extra).filter(F.col("_c") > full - 0.5).select(*VOXEL, *extra)
    offsets = neighbours(connectivity, iterations) if connectivity != 26 else []

    def compute(block: Block):
        if connectivity == 26:
            return box_sums(block.whole().astype(np.int16), 2 * iterations + 1) == full, {}
        left = block.here().copy()
        for o in offsets:
            left &= block.here(o)
        return left, {}

    return map_voxels(mask, iterations, [], compute, extra=extra)


def close_mask(mask: DataFrame, dims: DataFrame, connectivity: int = 26, iterations: int = 1) -> DataFrame:
    return erode(dilate(mask, dims, connectivity, iterations), dims, connectivity, iterations)


# --- separable filters -------------------------------------------------------------------------------


def convolve(
    voxels: DataFrame, dims: DataFrame, values: dict[str, str], weights: Sequence[float], mode: str, extra: Sequence[str] = (), axes: str = "xyz"
) -> DataFrame:
    """Separable filter of value columns (``{output: input}``), one shuffle of image lines per axis.

    Voxels that are absent count 0, positions whose results are all 0 are left out.  ``extra`` columns
    are part of the key, e.g. the label when each label is filtered on its own.
    """
    names = list(values)
    rows = with_dims(voxels.select(*VOXEL, *extra, *(F.col(values[n]).cast("double").alias(n) for n in names)), dims)
    run = line_filter(weights, mode)
    for a in axes:
        others = [c for c in [*VOXEL, *extra] if c != a]
        lines = rows.groupBy(*others, "nx", "ny", "nz").agg(F.collect_list(F.struct(a, *names)).alias("_p"))
        done = lines.select(*others, "nx", "ny", "nz", *(run(F.col("_p")[a], F.col("_p")[n], F.col(f"n{a}")).alias(n) for n in names))
        zipped = done.select(*others, "nx", "ny", "nz", F.posexplode(F.arrays_zip(*names)).alias(a, "_v"))
        rows = zipped.select(*VOXEL, *extra, "nx", "ny", "nz", *(F.col(f"_v.{n}").alias(n) for n in names))
        live = F.lit(False)
        for n in names:
            live = live | (F.col(n) != 0)
        rows = rows.filter(live)
    return rows.select(*VOXEL, *extra, *names)


def box_sum(voxels: DataFrame, dims: DataFrame, values: dict[str, str], size: int, mode: str, extra: Sequence[str] = ()) -> DataFrame:
    return convolve(voxels, dims, values, box_weights((size - 1) // 2), mode, extra)


def box_mean(voxels: DataFrame, dims: DataFrame, value: str, size: int, mode: str, out: str = "mean") -> DataFrame:
    sums = box_sum(voxels, dims, {out: value}, size, mode)
    return sums.withColumn(out, F.col(out) / float(size**3))


def gaussian(voxels: DataFrame, dims: DataFrame, values: dict[str, str], sigma: float, mode: str = "reflect", extra: Sequence[str] = ()) -> DataFrame:
    return convolve(voxels, dims, values, gaussian_weights(sigma), mode, extra)


# --- slices and gradients ----------------------------------------------------------------------------


def gradient_nonzero(voxels: DataFrame, label: str = "seg", axes: str = "xyz", keep: Sequence[str] = ()) -> DataFrame:
    """Add ``has_gradient``: a central difference (one-sided at the image edge) is not 0 on some axis."""

    def compute(block: Block):
        own = block.at(label)
        moved = np.zeros(own.shape, bool)
        for a in axes:
            low, high = (
                np.where(block.here(o), block.at(label, o), own) for o in (tuple(step * (a == b) for b in "xyz") for step in (-1, 1))
            )
            moved |= low != high
        return block.here(), {"has_gradient": moved}

    return map_voxels(voxels, 1, [label], compute, "has_gradient boolean", [label, *keep])


def thick_slices(voxels: DataFrame, thickness: int, value: str, axis: str = "z", size: int | None = None) -> DataFrame:
    """Each slice with its ``thickness`` neighbours on both sides as an array, edges repeated.

    The edges are those of the stored line, or those of an image of ``size`` positions, in which slices that are not
    stored are NULL.  A window per image line, whose length is bounded by the image size.
    """
    from pyspark.sql import Window

    others = [c for c in VOXEL if c != axis]
    line = Window.partitionBy(*others).orderBy(axis)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place, first, last = F.col(axis), F.first(value).over(whole), F.last(value).over(whole)
    if size is not None:
        first, last = F.when(F.first(axis).over(whole) == 0, first), F.when(F.last(axis).over(whole) == size - 1, last)
    parts = []
    for step in range(-thickness, thickness + 1):
        if step == 0:
            parts.append(F.col(value))
        elif size is not None:
            there = F.first(value).over(line.rangeBetween(step, step))
            parts.append(F.when(place + step < 0, first).when(place + step >= size, last).otherwise(there))
        elif step < 0:
            parts.append(F.coalesce(F.lag(value, -step).over(line), first))
        else:
            parts.append(F.coalesce(F.lead(value, step).over(line), last))
    return voxels.withColumn("slab", F.array(*parts))


def drop_blank_slices(voxels: DataFrame, threshold: int, label: str = "label", by: Sequence[str] = (SUBJECT, "z")) -> DataFrame:
    """Keep slices whose label values add up to more than ``threshold`` (values, not voxels)."""
    kept = voxels.groupBy(*by).agg(F.sum(label).alias("_s")).filter(F.col("_s") > threshold).select(*by)
    return attach(voxels, kept, list(by), "inner")


# --- masks built from neighbourhoods -----------------------------------------------------------------


def cortex_border(voxels: DataFrame, dims: DataFrame, threshold: int = 33, label: str = "seg") -> DataFrame:
    """Voxels of cortex labels that one erosion of the labelled mask takes away."""

    def compute(block: Block):
        return block.here() & (block.at(label) > threshold) & (box_sums(block.whole().astype(np.int16), 3) < 27), {}

    return map_voxels(voxels.filter(F.col(label) >= 1), 1, [label], compute)


def closing_difference(voxels: DataFrame, dims: DataFrame, threshold: int = 33, iterations: int = 1, label: str = "seg") -> DataFrame:
    """Voxels that a closing of the cortex mask changes: deep sulci and thin strands.

    Growing (inside the image) and shrinking are one pass over blocks with a halo of both.
    """
    cortex = with_dims(voxels.filter(F.col(label) > threshold).select(*VOXEL), dims)
    if 2 * iterations > BLOCK_STEPS:
        cortex = cortex.select(*VOXEL)
        closed = materialize(close_mask(cortex, dims, 26, iterations), "closed")
        return closed.join(cortex, VOXEL, "left_anti").unionByName(cortex.join(closed, VOXEL, "left_anti"))
    size, sizes = 2 * iterations + 1, ["nx", "ny", "nz"]

    def compute(block: Block) -> np.ndarray:
        grown = box_sums(block.whole().astype(np.int16), size) > 0
        for axis, n in enumerate(sizes):
            at = np.arange(grown.shape[axis]) + block.low[axis] - iterations
            outside = (at < 0) | (at >= block.whole(n).max())
            grown[tuple(outside if i == axis else slice(None) for i in range(3))] = False
        return (box_sums(grown.astype(np.int16), size) == size**3) != block.here()

    return map_cells(cortex, 2 * iterations, compute, names=sizes)


def contact_volume(voxels: DataFrame, headers: DataFrame, labels: Sequence[int], background: int = 0, label: str = "seg") -> DataFrame:
    """Volume of background voxels next to (6 neighbours) a region."""
    sides = voxels.select(*VOXEL, F.when(is_in(label, labels), 1).when(F.col(label) == background, 0).alias("_in"))

    def compute(block: Block):
        own = block.at("_in")
        touched = np.zeros(own.shape, bool)
        for o in neighbours(6):
            touched |= block.at("_in", o) == 1
        return block.here() & (own == 0) & touched, {}

    touched = map_voxels(sides.filter("_in IS NOT NULL"), 1, ["_in"], compute)
    counts = touched.groupBy(SUBJECT).agg(F.count(F.lit(1)).alias("n_voxels"))
    out = headers.select(SUBJECT, "vox_vol").join(counts, SUBJECT, "left").fillna(0, subset=["n_voxels"])
    return out.select(SUBJECT, "n_voxels", (F.col("n_voxels") * F.col("vox_vol")).alias("volume"))


def split_sided_label(
    voxels: DataFrame, dims: DataFrame, left_markers: Sequence[int], wanted: int = 77, share: float = 0.2, size: int = 7, label: str = "seg"
) -> DataFrame:
    """Side of each voxel of an unsided label: left where left labels fill more than ``share`` of its box."""
    markers = voxels.filter(is_in(label, left_markers)).select(*VOXEL, F.lit(1.0).alias("_m"))
    fill = box_mean(markers, dims, "_m", size, "reflect", "_share")
    rows = voxels.filter(F.col(label) == wanted).select(*VOXEL).join(fill, VOXEL, "left")
    return rows.select(*VOXEL, F.when(F.coalesce("_share", F.lit(0.0)) > share, "left").otherwise("right").alias("side"))


def nearest_nonzero(points: DataFrame, voxels: DataFrame, radius: float, vox_size: float = 1.0, label: str = "seg") -> DataFrame:
    """Nearest non-zero label in a ball round each point's voxel (``px, py, pz``); 0 where there is none.

    Equal distances are ordered by offsets nudged by 0.001, 0.002 and 0.003.  Points keep all columns.
    """
    r = radius / vox_size
    side = range(-int(r), int(r) + 1)
    ball = [o for o in product(side, repeat=3) if (o[0] ** 2 + o[1] ** 2 + o[2] ** 2) ** 0.5 <= r]
    nudged = {o: (o[0] + 0.001) ** 2 + (o[1] + 0.002) ** 2 + (o[2] + 0.003) ** 2 for o in ball}
    ordered = sorted(ball, key=nudged.__getitem__)
    asked = points.select(SUBJECT, *(F.col(f"p{a}").cast("int").alias(a) for a in "xyz")).distinct()
    probes = send(asked.select("*", *(F.col(a).alias(f"p{a}") for a in "xyz")), ordered)
    hits = probes.join(voxels.filter(not_in(label, [0])).select(*VOXEL, F.col(label).alias("_l")), VOXEL)
    best = hits.groupBy(SUBJECT, "px", "py", "pz").agg(F.min_by("_l", "_k").alias("nearest"))
    return points.join(best, [SUBJECT, "px", "py", "pz"], "left").fillna(0, subset=["nearest"])

"""Training slices from labelled volumes: voxel weights, slabs, and deterministic augmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.operators import grid as G
from volspark.operators.labels import VOXEL, to_plane
from volspark.operators.mapping import map_labels
from volspark.operators.regions import SUBJECT, class_weights
from volspark.plans.joins import attach, literal_table
from volspark.plans.ordered import row_positions
from volspark.plans.storage import materialize

# Label of the other side for each cerebellum part label 0..27.
FLIPPED_LABELS = [0, 2, 1, 4, 3, 7, 6, 5, 9, 8, 11, 10, 13, 12, 14, 16, 15, 18, 17, 19, 22, 21, 20, 25, 24, 23, 27, 26]
# Weights of the two input modalities by the images that exist.
MODALITY_WEIGHTS = {"t1": (1.0, 0.0), "t2": (0.0, 1.0), "t1t2": (0.5, 0.5)}


def voxel_weights(
    voxels: DataFrame, dims: DataFrame, label: str = "seg", max_weight: float = 5.0, edge_weight: float = 5.0, hires_weight: int | None = None,
    threshold: int = 33, cortex: bool = True, gradient: bool = True, mean_filter: bool = False, keep: Sequence[str] = (),
) -> DataFrame:
    """Loss weight per voxel: class frequency, plus edges, plus deep sulci and strands, plus the cortex border.

    The cortex share is half the high-resolution weight, rounded down.
    """
    classes = class_weights(voxels, max_weight, label).select(SUBJECT, label, "weight")
    rows = G.gradient_nonzero(voxels, label, keep=keep) if gradient else voxels.select(*VOXEL, label, *keep)
    rows = attach(rows, classes, [SUBJECT, label])
    if gradient:
        rows = rows.withColumn("weight", F.col("weight") + F.when(F.col("has_gradient"), float(edge_weight)).otherwise(0.0)).drop("has_gradient")
    if hires_weight is not None:
        extra = [(G.closing_difference(voxels, dims, threshold, 1, label), hires_weight)]
        if cortex:
            extra.append((G.cortex_border(voxels, dims, threshold, label), hires_weight // 2))
        for mask, w in extra:
            rows = rows.join(mask.withColumn("_in", F.lit(float(w))), VOXEL, "left")
            rows = rows.withColumn("weight", F.col("weight") + F.coalesce("_in", F.lit(0.0))).drop("_in")
    if mean_filter:
        rows = materialize(rows, "weights")
        smooth = G.box_mean(rows, dims, "weight", 3, "reflect", "_mean")
        rows = rows.join(smooth, VOXEL, "left").withColumn("weight", F.coalesce("_mean", F.lit(0.0))).drop("_mean")
    return rows


def slice_weights(pixels: DataFrame, weights: DataFrame, label: str = "seg", edge_weight: float = 5.0) -> DataFrame:
    """Two-dimensional form: class weights by label plus the edge weight within each slice."""
    rows = attach(G.gradient_nonzero(pixels, label, "xy"), weights.select(SUBJECT, label, "weight"), [SUBJECT, label])
    edge = F.when(F.col("has_gradient"), float(edge_weight)).otherwise(0.0)
    return rows.withColumn("weight", F.col("weight") + edge).drop("has_gradient")


def build_slabs(
    voxels: DataFrame, dims: DataFrame, plane: str, thickness: int = 3, blank_threshold: int = 50, mapping: DataFrame | None = None, **weights
) -> DataFrame:
    """Slices of one viewing plane with neighbours, labels and weights: ``subject_id, plane, size, slice, u, v, slab, label, weight``.

    ``size`` is the image's largest extent, the group key of the slab store.
    """
    rows = map_labels(voxels, mapping) if mapping is not None else voxels
    rows = voxel_weights(rows.select(*VOXEL, "seg", "norm"), dims, keep=["norm"], **weights)
    rows = to_plane(rows.select(*VOXEL, "norm", F.col("seg").alias("label"), "weight"), plane)
    thick = G.thick_slices(rows, thickness, "norm", "z")
    kept = G.drop_blank_slices(thick, blank_threshold, "label")
    sized = attach(kept, dims, SUBJECT, "inner", costly=False)
    size = F.greatest("nx", "ny", "nz")
    return sized.select(SUBJECT, F.lit(plane).alias("plane"), size.alias("size"), F.col("z").alias("slice"), F.col("x").alias("u"), F.col("y").alias("v"), "slab", "label", "weight")


def subject_problems(voxels: DataFrame, dims: DataFrame, mapping: DataFrame | None = None, label: str = "seg", value: str = "norm") -> DataFrame:
    """``subject_id, reason`` of subjects that slabs can't be built for; the first reason that holds."""
    top = mapping.agg(F.max("src")).first()[0] if mapping is not None else None
    sized = attach(voxels, dims.select(SUBJECT, "nx", "ny", "nz"), SUBJECT, costly=False)
    outside = F.lit(False)
    for a in "xyz":
        outside = outside | (F.col(a) < 0) | (F.col(a) >= F.col(f"n{a}"))
    above = F.lit(False) if top is None else F.col(label) > top
    seen = sized.groupBy(SUBJECT).agg(
        F.bool_or(F.col("nx").isNull()).alias("_unsized"), F.bool_or(outside).alias("_outside"), F.count_if(F.col(label).isNull()).alias("_unlabelled"),
        F.count_if(F.col(value).isNull() | F.isnan(F.col(value).cast("double"))).alias("_blank"), F.max(F.when(above, F.col(label))).alias("_above"),
    )
    reason = (
        F.when(F.col("_unsized"), "no image size")
        .when(F.col("_outside"), "voxel outside the image")
        .when(F.col("_unlabelled") > 0, "voxel without a label")
        .when(F.col("_blank") > 0, "voxel without an intensity")
        .when(F.col("_above").isNotNull(), F.concat(F.lit("label above the map: "), F.col("_above").cast("string")))
    )
    return seen.select(SUBJECT, reason.alias("reason")).filter("reason IS NOT NULL")


def build_slabs_logged(
    voxels: DataFrame, dims: DataFrame, plane: str, thickness: int = 3, blank_threshold: int = 50, mapping: DataFrame | None = None, stage: str = "slabs", **weights
) -> tuple[DataFrame, DataFrame]:
    """Slabs of all sound subjects, and a status row (``subject_id, stage, state``) for each of the others.

    One subject that can't be built neither fails the job nor leaves half of its slices behind.
    """
    problems = materialize(subject_problems(voxels, dims, mapping), "problems")
    marked = attach(voxels, problems.select(SUBJECT, F.lit(True).alias("_bad")), SUBJECT)
    slabs = build_slabs(marked.filter("_bad IS NULL").drop("_bad"), dims, plane, thickness, blank_threshold, mapping, **weights)
    log = problems.select(SUBJECT, F.lit(stage).alias("stage"), F.concat(F.lit("Failed: "), F.col("reason")).alias("state"))
    return slabs, log


# --- deterministic augmentation ----------------------------------------------------------------------


def hash_uniform(seed: int, *keys: str) -> Column:
    """Number in [0, 1) that depends on the keys and the seed only, so a recomputed task draws it again."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(2**53)) / float(2**53)


def hash_normal(seed: int, *keys: str) -> Column:
    """Standard normal draw from two uniform ones."""
    u = 1.0 - hash_uniform(2 * seed, *keys)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * 3.141592653589793 * hash_uniform(2 * seed + 1, *keys))


def crop_slices(pixels: DataFrame, size: tuple[int, int], height: Column, width: Column, key: str | None = None, seed: int = 0) -> DataFrame:
    """Centre crop (``key`` None), or a crop whose corner is drawn per ``key``."""
    room = [height - size[0], width - size[1]]
    if key is None:
        corner = [F.floor(r / 2) for r in room]
    else:
        corner = [F.floor(hash_uniform(seed + i, key) * r) for i, r in enumerate(room)]
    out = pixels.withColumn("_t", corner[0]).withColumn("_l", corner[1])
    out = out.withColumn("u", (F.col("u") - F.col("_t")).cast("int")).withColumn("v", (F.col("v") - F.col("_l")).cast("int")).drop("_t", "_l")
    return out.filter(F.col("u").between(0, size[0] - 1) & F.col("v").between(0, size[1] - 1))


def jitter(scale: str, key: str, std: float = 0.1, mean: float = 0.0, seed: int = 0) -> Column:
    """Scale factor plus one normal draw per sample."""
    return F.col(scale) + hash_normal(seed, key) * std + mean


def zoomed_scale(zoom: Sequence[str], scale: Sequence[str], base: float = 1.0, noise_key: str | None = None, seed: int = 0) -> list[Column]:
    """Scale factors after zoom augmentation (applied if all factors are positive), noisy if asked, at least 0.1."""
    all_positive = F.lit(True)
    for s in scale:
        all_positive = all_positive & (F.col(s) > 0)
    out = []
    for z, s in zip(zoom, scale, strict=True):
        factor = base / F.when(all_positive, F.col(z) / F.nullif(F.col(s), F.lit(0))).otherwise(F.col(z))
        if noise_key is not None:
            factor = F.greatest(factor + hash_normal(seed, noise_key) * 0.1, F.lit(0.1))
        out.append(factor)
    return out


def flip_sides(voxels: DataFrame, dims: DataFrame, axis: str = "x", label: str = "seg", swap: bool = True) -> DataFrame:
    """Mirror one axis and give side labels their partner's id."""
    from volspark.operators.labels import flip

    out = flip(voxels, dims, axis)
    if not swap:
        return out
    return out.withColumn(label, F.element_at(F.lit(FLIPPED_LABELS).cast("array<int>"), F.col(label) + 1))


def bias_field(order: int, coefficients: str, dims: Sequence[str] = ("nx", "ny", "nz")) -> Column:
    """exp of a polynomial in coordinates scaled to -1..1; coefficients run over x, y, z orders, z fastest."""
    unit = []
    for a, n in zip("xyz", dims, strict=True):
        half = F.col(n) / 2.0
        unit.append((F.col(a) - half + 0.5) / (half - 0.5))
    total, i = F.lit(0.0), 0
    for xo in range(order + 1):
        for yo in range(order + 1 - xo):
            for zo in range(order + 1 - xo - yo):
                term = F.col(coefficients)[i]
                for base, power in zip(unit, (xo, yo, zo), strict=True):
                    for _ in range(power):
                        term = term * base
                total, i = total + term, i + 1
    return F.exp(total)


def synthetic_intensity(voxels: DataFrame, classes: DataFrame, seed: int = 0, label: str = "seg") -> DataFrame:
    """Intensity drawn from each label's mean and deviation (``classes``: label, mean, std)."""
    rows = attach(voxels, classes, label, costly=False)
    value = F.col("mean") + F.col("std") * hash_normal(seed, *VOXEL)
    return rows.withColumn("synthetic", value).drop("mean", "std")


def join_modalities(t1: DataFrame | None, t2: DataFrame | None, key: Sequence[str], slab: str = "slab") -> DataFrame:
    """Channels of both modalities one after the other (a single one twice), with their weights."""
    if t1 is not None and t2 is not None:
        both = t1.select(*key, F.col(slab).alias("_a")).join(t2.select(*key, F.col(slab).alias("_b")), list(key))
        mode = "t1t2"
    else:
        mode = "t1" if t1 is not None else "t2"
        one = t1 if t1 is not None else t2
        if one is None:
            raise ValueError("no modality given")
        both = one.select(*key, F.col(slab).alias("_a"), F.col(slab).alias("_b"))
    w = MODALITY_WEIGHTS[mode]
    return both.select(*key, F.concat("_a", "_b").alias(slab), F.lit(w[0]).alias("w1"), F.lit(w[1]).alias("w2"))


def class_names(table: DataFrame, plane: str, options: Sequence[str]) -> DataFrame:
    """Class names of a plane in the order of the options (``space, option, pos, class_name``)."""
    space = "sagittal" if plane == "sagittal" else "not_sagittal"
    order = literal_table(table.sparkSession, [(o, i) for i, o in enumerate(options)], "option string, _o int")
    chosen = table.filter(F.col("space") == space).join(order, "option")
    return chosen.select(F.col("_o").alias("option_no"), "pos", "class_name")


def add_auxiliary(labelled: DataFrame, auxiliary: DataFrame, fraction: float, key: str) -> DataFrame:
    """Labelled rows and every ``int(1 / fraction)``-th auxiliary row by ``key``."""
    stride = int(1.0 / fraction)
    picked = row_positions(auxiliary, [], key, "_pos").filter(F.col("_pos") % stride == 0).drop("_pos")
    return labelled.withColumn("auxiliary", F.lit(False)).unionByName(picked.withColumn("auxiliary", F.lit(True)))


def template_average(time_points: DataFrame, base: str = "base_id", value: str = "norm", mask: str = "mask") -> DataFrame:
    """Mean and median over aligned time points and the union of their masks, per template voxel."""
    return time_points.groupBy(base, "x", "y", "z").agg(
        F.avg(value).alias("mean"), F.median(value).alias("median"), F.max(mask).alias("mask")
    )


def plot_slices(voxels: DataFrame, label: str = "seg", axis: str = "x", step: int = 2, ventricle: int = 10, core_above: int = 100, optic_to: int = 2) -> DataFrame:
    """Slices to draw: all with core labels, every 4th with optic labels, every ``step``-th of the other labelled ones.

    Slices whose lowest label is the ventricle are not among the others.
    """
    c = F.col(label)
    slices = voxels.filter(c > 0).groupBy(SUBJECT, axis).agg(
        F.min(c).alias("_low"), F.bool_or(c > core_above).alias("_core"), F.bool_or(c <= optic_to).alias("_optic")
    )
    kind = F.when(~F.col("_core") & ~F.col("_optic") & (F.col("_low") != ventricle), "other")
    kinds = F.array_compact(F.array(F.when(F.col("_core"), F.lit("core")), F.when(F.col("_optic"), F.lit("optic")), kind))
    rows = slices.select(SUBJECT, axis, F.explode(kinds).alias("kind"))
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(SUBJECT, "kind").orderBy(axis)) - 1
    every = F.when(F.col("kind") == "core", 1).when(F.col("kind") == "optic", 4).otherwise(step)
    return rows.withColumn("_at", at).filter(F.col("_at") % every == 0).select(SUBJECT, axis, "kind")

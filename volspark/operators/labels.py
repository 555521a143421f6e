"""Label rewriting and voxel coordinate changes: projections, and equi joins between aligned volumes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.operators.regions import SUBJECT, is_in
from volspark.plans.joins import attach

VOXEL = [SUBJECT, "x", "y", "z"]

# Label replacements applied before training and the two cortex ids that become background.
CORTEX_CLEANING = {80: 77, 85: 0, 62: 41, 30: 2, 72: 24, 29: 0, 61: 0, 3: 0, 42: 0}
# Replacements for whole-structure processing.
STRUCTURE_CLEANING = {1000: 3, 2000: 42, 80: 77, 85: 0, 62: 41, 30: 2, 72: 24}
# Corpus callosum ids, and the right-hand parcels that keep their side when sides are fused.
CALLOSUM = range(251, 256)
KEPT_RIGHT_PARCELS = [2014, 2028, 2012, 2016, 2002, 2023, 2017, 2024, 2010, 2013, 2025, 2022, 2021, 2005]
# Cerebellum ids (cortex and white matter of both sides).
CEREBELLUM = [7, 46, 8, 47]


def replace_labels(label: str, changes: Mapping[int, int]) -> Column:
    """All replacements look at the original label; others stay."""
    col = F.col(label)
    out = None
    for src, dst in changes.items():
        out = F.when(col == src, dst) if out is None else out.when(col == src, dst)
    return (out.otherwise(col) if out is not None else col).cast("int")


def reduce_ranges(label: str) -> Column:
    """Parcels of the right cortex become 42, those of the left cortex 3."""
    col = F.col(label)
    return F.when(col >= 2000, 42).when(col >= 1000, 3).otherwise(col).cast("int")


def clean_cortex(label: str) -> Column:
    return replace_labels(label, CORTEX_CLEANING)


def clean_structures(voxels: DataFrame, label: str = "seg") -> DataFrame:
    """Replacement for structure processing; raises where a callosum id is left or a cortex side is missing."""
    out = voxels.withColumn(label, replace_labels(label, STRUCTURE_CLEANING))
    checks = out.groupBy(SUBJECT).agg(
        F.max(label).alias("_top"), F.bool_or(F.col(label) == 3).alias("_l"), F.bool_or(F.col(label) == 42).alias("_r")
    )
    bad = checks.filter((F.col("_top") >= 251) | ~F.col("_l") | ~F.col("_r")).limit(1).collect()
    if bad:
        raise ValueError(f"subject {bad[0][SUBJECT]}: callosum ids remain or a cortex marker is missing")
    return out


def fuse_parcels(label: str, original: str | None = None) -> Column:
    """Right parcels 2000..2999 take the left id, except those listed as kept on their side."""
    col = F.col(label)
    source = F.col(original or label)
    kept = source.isin(KEPT_RIGHT_PARCELS)
    return F.when(kept, source).when(col.between(2000, 2999), col - 1000).otherwise(col).cast("int")


def paint_over(voxels: DataFrame, other: DataFrame, label: str = "seg", low: int = 251, high: int = 255) -> DataFrame:
    """Take the label of the second volume wherever it lies in ``low..high``."""
    paint = other.select(*VOXEL, F.col(label).alias("_paint")).filter(F.col("_paint").between(low, high))
    return voxels.join(paint, VOXEL, "left").withColumn(label, F.coalesce("_paint", label)).drop("_paint")


def apply_mask(voxels: DataFrame, mask: DataFrame, label: str = "seg") -> DataFrame:
    """Label 0 outside the mask (``mask`` lists the voxels inside)."""
    inside = mask.select(*VOXEL).withColumn("_in", F.lit(True))
    out = voxels.join(inside, VOXEL, "left")
    return out.withColumn(label, F.when(F.col("_in"), F.col(label)).otherwise(0).cast("int")).drop("_in")


def resolve_overlap(voxels: DataFrame, first: str, second: str, first_is_manual: bool) -> DataFrame:
    """Where both labels are set the manual one wins and the other becomes 0."""
    winner, loser = (first, second) if first_is_manual else (second, first)
    return voxels.withColumn(loser, F.when(F.col(winner) != 0, 0).otherwise(F.col(loser)).cast("int"))


def lateral_mask(label: str, ids: Sequence[int]) -> Column:
    """True on any of the ids (the evident intent of a lateral mask)."""
    return is_in(label, ids)


# --- coordinates -------------------------------------------------------------------------------------


def crop(voxels: DataFrame, offset: Sequence[int], size: Sequence[int]) -> DataFrame:
    """Window of ``size`` from ``offset``; a negative offset pads (empty cells are simply absent)."""
    out = voxels
    for a, o, n in zip("xyz", offset, size, strict=True):
        out = out.filter((F.col(a) >= o) & (F.col(a) < o + n))
    return out.select(*((F.col(c) - offset["xyz".index(c)]).alias(c) if c in "xyz" else c for c in voxels.columns))


def uncrop(voxels: DataFrame, offset: Sequence[int]) -> DataFrame:
    return voxels.select(*((F.col(c) + offset["xyz".index(c)]).alias(c) if c in "xyz" else c for c in voxels.columns))


def centre_offset(image: Column | int, target: int) -> Column:
    """Default crop offset: half the difference, cut towards zero."""
    return ((image - F.lit(target)) / 2).cast("int")


def pad_offset(image: Column | int, target: int) -> Column:
    """Offset for padding to a base size: floor of half the difference, negative where the image is smaller."""
    return -F.floor((F.lit(target) - image) / 2).cast("int")


def _moved(voxels: DataFrame, dims: DataFrame, target: Sequence[int], offset) -> DataFrame:
    out = attach(voxels, dims.select(SUBJECT, "nx", "ny", "nz"), SUBJECT, "inner", costly=False)
    for a, n in zip("xyz", target, strict=True):
        out = out.withColumn(a, (F.col(a) - offset(F.col(f"n{a}"), n)).cast("int")).filter(F.col(a).between(0, n - 1))
    return out.select(*voxels.columns)


def crop_centred(voxels: DataFrame, dims: DataFrame, target: Sequence[int]) -> DataFrame:
    """Window of the target size in the middle of each subject's image."""
    return _moved(voxels, dims, target, centre_offset)


def pad_to_base(voxels: DataFrame, dims: DataFrame, target: Sequence[int]) -> DataFrame:
    """Each subject's image in the middle of a base size; empty cells are simply absent, larger images are cut."""
    return _moved(voxels, dims, target, pad_offset)


def pad_edges(voxels: DataFrame, dims: DataFrame, width: int) -> DataFrame:
    """Repeat the border voxels ``width`` times on every side; coordinates shift by ``width``."""
    out = attach(voxels, dims, SUBJECT, "inner", costly=False)
    for a in "xyz":
        c, n = F.col(a), F.col(f"n{a}")
        first = F.when(c == 0, 0).otherwise(c + width)
        last = F.when(c == n - 1, c + 2 * width).otherwise(c + width)
        out = out.withColumn(a, F.explode(F.sequence(first, last)))
    return out.drop("nx", "ny", "nz")


def fit_square(pixels: DataFrame, size: int, axes: Sequence[str] = ("x", "y")) -> DataFrame:
    """Top-left pad or cut to a square; padding is implicit, each axis is cut to ``size``."""
    out = pixels
    for a in axes:
        out = out.filter(F.col(a) < size)
    return out


def permute(voxels: DataFrame, order: str) -> DataFrame:
    """New axes x, y, z take their values from the named old axes, e.g. ``"zxy"``."""
    moved = dict(zip("xyz", order, strict=True))
    return voxels.select(*(F.col(moved[c]).alias(c) if c in moved else F.col(c) for c in voxels.columns))


# Axis orders of the viewing planes relative to the coronal view.
PLANE_ORDERS = {"coronal": "xyz", "axial": "zxy", "sagittal": "zyx"}


def to_plane(voxels: DataFrame, plane: str) -> DataFrame:
    return permute(voxels, PLANE_ORDERS[plane])


def from_plane(voxels: DataFrame, plane: str) -> DataFrame:
    order = PLANE_ORDERS[plane]
    return permute(voxels, "".join("xyz"[order.index(a)] for a in "xyz"))


def flip(voxels: DataFrame, dims: DataFrame, axes: str) -> DataFrame:
    """Mirror the named axes inside the image."""
    out = attach(voxels, dims, SUBJECT, "inner", costly=False)
    for a in axes:
        out = out.withColumn(a, (F.col(f"n{a}") - 1 - F.col(a)).cast("int"))
    return out.drop("nx", "ny", "nz")


def orient_to(voxels: DataFrame, plan: DataFrame, dims: DataFrame) -> DataFrame:
    """Bring each subject to its reference axes: flip first, then permute.

    ``plan`` has one row per subject: ``flip_x/y/z`` booleans and ``from_x/y/z``, the old axis (0, 1, 2)
    that feeds each new one.
    """
    out = attach(voxels, plan.join(dims, SUBJECT), SUBJECT, "inner")
    turned = [F.when(F.col(f"flip_{a}"), F.col(f"n{a}") - 1 - F.col(a)).otherwise(F.col(a)) for a in "xyz"]
    pick = F.array(*turned)
    new = {a: F.element_at(pick, F.col(f"from_{a}") + 1).cast("int") for a in "xyz"}
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in voxels.columns))


def plan_orientation(headers: DataFrame, reference: str = "ref_affine", own: str = "affine") -> DataFrame:
    """Flips and axis order that bring ``own`` affines to ``reference`` ones, from each column's dominant row."""

    def dominant(affine: str, c: int) -> tuple[Column, Column]:
        column = F.array(*(F.abs(F.col(affine)[r][c]) for r in range(3)))
        row = F.array_position(column, F.array_max(column)).cast("int") - 1
        return row, F.signum(F.element_at(F.col(affine), row + 1)[c])

    own_axes = [dominant(own, c) for c in range(3)]
    ref_axes = [dominant(reference, c) for c in range(3)]
    cols = []
    rows_own = F.array(*(r for r, _ in own_axes))
    rows_ref = F.array(*(r for r, _ in ref_axes))
    signs_ref = F.array(*(s for _, s in ref_axes))
    for c, a in enumerate("xyz"):
        target = F.array_position(rows_ref, own_axes[c][0]).cast("int")
        cols.append((F.element_at(signs_ref, target) != own_axes[c][1]).alias(f"flip_{a}"))
        cols.append((F.array_position(rows_own, ref_axes[c][0]).cast("int") - 1).alias(f"from_{a}"))
    return headers.select(SUBJECT, *cols)


def apply_affine(points: DataFrame, transforms: DataFrame, names: Sequence[str] = ("x", "y", "z"), out: Sequence[str] = ("wx", "wy", "wz")) -> DataFrame:
    """Homogeneous 4x4 map of coordinates; ``transforms`` has one matrix ``m`` per subject."""
    joined = attach(points, transforms.select(SUBJECT, "m"), SUBJECT, costly=False)
    for r, o in enumerate(out):
        row = F.col("m")[r]
        joined = joined.withColumn(
            o, row[0] * F.col(names[0]) + row[1] * F.col(names[1]) + row[2] * F.col(names[2]) + row[3]
        )
    return joined.drop("m")


def nearest_lookup(points: DataFrame, volume: DataFrame, value: str = "seg", names: Sequence[str] = ("wx", "wy", "wz")) -> DataFrame:
    """Value of the voxel nearest to each point (half to even); NULL outside the image."""
    keyed = points
    for a, n in zip("xyz", names, strict=True):
        keyed = keyed.withColumn(f"_{a}", F.rint(n).cast("int"))
    src = volume.select(SUBJECT, *(F.col(a).alias(f"_{a}") for a in "xyz"), F.col(value).alias("sample"))
    return keyed.join(src, [SUBJECT, "_x", "_y", "_z"], "left").drop("_x", "_y", "_z")


def warp_labels(field: DataFrame, volume: DataFrame, value: str = "seg") -> DataFrame:
    """Pull labels through a displacement field (``dx, dy, dz`` per target voxel), nearest neighbour, 0 outside."""
    moved = field
    for a in "xyz":
        moved = moved.withColumn(f"w{a}", F.col(a) + F.col(f"d{a}"))
    out = nearest_lookup(moved, volume, value)
    return out.select(*VOXEL, F.coalesce("sample", F.lit(0)).alias(value))


# --- image headers -----------------------------------------------------------------------------------


def scale_factors(headers: DataFrame, base: float = 1.0) -> DataFrame:
    """Resolution ratio of the two in-plane axes for each viewing plane, from ``zooms``."""
    zoom = F.col("zooms")
    in_plane = {
        "sagittal": F.slice(F.reverse(zoom), 1, 2),
        "axial": F.slice(zoom, 2, 2),
        "coronal": F.slice(zoom, 1, 2),
    }
    rows = F.explode(F.create_map(*(x for p, z in in_plane.items() for x in (F.lit(p), z)))).alias("plane", "z")
    out = headers.select(SUBJECT, rows)
    ratio = [(F.lit(base) / F.col("z")[i]).alias(f"factor_{i}") for i in (0, 1)]
    return out.select(SUBJECT, "plane", *ratio)


def smallest_zoom(max_size: float = 1.0) -> Column:
    return F.least(F.rint(F.array_min("zooms") * 10000) / 10000, F.lit(max_size))


def field_of_view_size(vox_size: Column, min_dim: int = 256) -> Column:
    fov = F.array_max(F.zip_with("zooms", "dims", lambda z, n: z * n))
    needed = F.ceil(F.floor(fov / vox_size * 10000) / 10000)
    return F.when(vox_size == 1.0, min_dim).otherwise(F.greatest(F.lit(min_dim), needed)).cast("int")


def target_size(vox_size: float | str = "min", to_1mm_above: float | None = None) -> tuple[Column, Column]:
    """Voxel size and cube size that a conformed image would have."""
    if vox_size in ("min", "auto"):
        size = smallest_zoom()
        if to_1mm_above:
            size = F.when(size > to_1mm_above, 1.0).otherwise(size)
    elif isinstance(vox_size, float) and 0.0 < vox_size <= 1.0:
        size = F.lit(vox_size)
    else:
        raise ValueError("voxel size must be 'min' or a float in (0, 1]")
    return size, field_of_view_size(size)


# Axes and signs of the left-inferior-anterior orientation, as (row, column): sign.
LIA = {(0, 0): -1, (2, 1): -1, (1, 2): 1}


def is_lia(strict: bool = True, eps: float = 1e-6) -> Column:
    """Orientation test on ``affine``; the strict form bounds the other entries from above only."""
    a = F.col("affine")
    ok = F.lit(True)
    for (r, c), sign in LIA.items():
        ok = ok & (F.signum(a[r][c]) == sign)
    for r in range(3):
        for c in range(3):
            if (r, c) in LIA:
                continue
            if strict:
                ok = ok & (a[r][c] <= eps)
            else:
                main = next(row for row, col in LIA if col == c)
                beats = F.abs(a[r][c]) < F.abs(a[main][c]) if r < main else F.abs(a[r][c]) <= F.abs(a[main][c])
                ok = ok & beats
    return ok


def conformity(headers: DataFrame, vox_size: float | str = 1.0, dtype: str = "uint8", strict: bool = True, eps: float = 1e-6) -> DataFrame:
    """One boolean per criterion and their conjunction; more than one frame is an error."""
    size, cube = target_size(vox_size)
    frames = F.when((F.size("dims") > 3) & (F.try_element_at("dims", F.lit(4)) != 1), F.raise_error(F.lit("multiple frames")))
    h = headers.withColumn("_size", size).withColumn("_cube", cube)
    checks = {
        "ok_dims": F.coalesce(frames.cast("boolean"), F.size("dims") == 3),
        "ok_size": F.forall(F.slice("dims", 1, 3), lambda n: n == F.col("_cube")),
        "ok_zoom": F.forall(F.slice("zooms", 1, 3), lambda z: F.abs(z - F.col("_size")) < eps),
        "ok_orientation": is_lia(strict, eps),
        "ok_dtype": F.col("dtype") == dtype,
    }
    out = h.select(SUBJECT, *(c.alias(n) for n, c in checks.items()))
    whole = F.lit(True)
    for n in checks:
        whole = whole & F.col(n)
    return out.withColumn("conform", whole)


def same_geometry(a: DataFrame, b: DataFrame, image: str = "image") -> DataFrame:
    """Equal dims, and affines equal within 1e-8 + 1e-5 of the second one's entries."""
    right = b.select(SUBJECT, F.col("dims").alias("dims_b"), F.col("affine").alias("affine_b"))
    near = F.forall(
        F.zip_with(
            F.flatten("affine"), F.flatten("affine_b"), lambda p, q: F.abs(p - q) <= 1e-8 + 1e-5 * F.abs(q)
        ),
        lambda t: t,
    )
    out = a.join(right, SUBJECT)
    return out.select(SUBJECT, (F.col("dims") == F.col("dims_b")).alias("same_dims"), near.alias("same_affine"))


def same_zoom(a: str, b: str, share: float = 0.05) -> Column:
    """Voxel sizes of two modalities within a relative share of the first."""
    return F.forall(F.zip_with(a, b, lambda p, q: F.abs(p - q) <= share * p), lambda t: t)


def header_consistent(tol: float = 1e-3) -> Column:
    """Column norms of the affine equal the stated voxel sizes."""
    a = F.col("affine")
    norms = F.array(*(F.sqrt(a[0][c] * a[0][c] + a[1][c] * a[1][c] + a[2][c] * a[2][c]) for c in range(3)))
    return F.forall(F.zip_with(norms, F.slice("zooms", 1, 3), lambda n, z: F.abs(n - z) <= tol), lambda t: t)


def effective_affine(first: str = "qform", second: str = "sform", tol: float = 1e-3) -> Column:
    """The second transform replaces the first where it exists and differs by more than ``tol``."""
    differs = F.exists(F.zip_with(F.flatten(first), F.flatten(second), lambda p, q: F.abs(p - q) > tol), lambda t: t)
    return F.when(F.col(second).isNotNull() & differs, F.col(second)).otherwise(F.col(first))


def modality_mode(manifest: DataFrame, none: str = "error") -> DataFrame:
    """``t1t2``, ``t1`` or ``t2`` by the images a subject has; a subject with neither is an error (``none="null"``: NULL)."""
    has = manifest.groupBy(SUBJECT).agg(
        F.bool_or(F.col("modality") == "t1").alias("t1"), F.bool_or(F.col("modality") == "t2").alias("t2")
    )
    mode = F.when(F.col("t1") & F.col("t2"), "t1t2").when(F.col("t1"), "t1").when(F.col("t2"), "t2")
    if none == "error":
        fail = F.raise_error(F.concat(F.lit("no image of a known modality for subject "), F.col(SUBJECT).cast("string"))).cast("string")
        mode = F.coalesce(mode, fail)
    return has.select(SUBJECT, mode.alias("mode"))

"""Named volume measures: a catalogue of definitions, and their evaluation as one join and one aggregate."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volspark.functions.matrix import det3
from volspark.operators.grid import split_sided_label
from volspark.operators.labels import VOXEL
from volspark.operators.mesh import enclosed_volume, euler_numbers
from volspark.operators.regions import SUBJECT, mask_volume, with_volume
from volspark.plans.joins import literal_table
from volspark.plans.storage import materialize

MM3 = "mm^3"
UNITLESS = "unitless"
# Fixed value: atlas scale of the intracranial volume estimate.
ETIV_SCALE = 1_948_106.0


@dataclass(frozen=True)
class Measure:
    """``classes`` for class volumes; ``parents`` as (factor, key) for ``sum``, ``ratio`` and ``by_vox_vol``."""

    key: str
    name: str
    description: str
    unit: str | None
    kind: str
    classes: tuple[int, ...] = ()
    parents: tuple[tuple[float, str], ...] = ()


def _volume(key, name, description, *classes):
    ids = [i for c in classes for i in (c if isinstance(c, range) else [c])]
    return Measure(key, name, description, MM3, "classes", tuple(ids))


def _derived(key, name, description, *parents, kind="sum"):
    pairs = tuple(p if isinstance(p, tuple) else (1.0, p) for p in parents)
    return Measure(key, name, description, None, kind, parents=pairs)


def _sided(make):
    return [make(h, s) for h, s in (("lh", "Left"), ("rh", "Right"))]


# Measure keys, names, descriptions, label ids and formulas.
_BRAIN = [
    2, 3, 4, 5, 7, 8, range(10, 16), 17, 18, 24, 26, 28, 30, 31, range(41, 45), 46, 47, range(49, 55),
    58, 60, 62, 63, 72, range(77, 83), range(251, 256),
]
_PARCELS = [1002, 1003, range(1005, 1032), 1034, 1035, 2002, 2003, range(2005, 2032), 2034, 2035]

CATALOGUE: dict[str, Measure] = {
    m.key: m
    for m in [
        *_sided(lambda h, s: Measure(f"{h}SurfaceHoles", f"{h}SurfaceHoles", f"Number of defect holes in {h} surfaces prior to fixing", UNITLESS, "mesh_holes")),
        _derived("SurfaceHoles", "SurfaceHoles", "Total number of defect holes in surfaces prior to fixing", "rhSurfaceHoles", "lhSurfaceHoles"),
        *_sided(lambda h, s: Measure(f"{h}PialTotal", f"{h}PialTotalVol", f"{s} hemisphere total pial volume", MM3, "mesh_volume")),
        *_sided(lambda h, s: Measure(f"{h}WhiteMatterTotal", f"{h}WhiteMatterSurfVol", f"{s} hemisphere total white matter volume", MM3, "mesh_volume")),
        _volume("lhWhiteMatterVol", "lhWhiteMatterVol", "Left hemisphere total white matter volume", 2, 78),
        _volume("rhWhiteMatterVol", "rhWhiteMatterVol", "Right hemisphere total white matter volume", 41, 79),
        *_sided(lambda h, s: _derived(f"{h}Cortex", f"{h}CortexVol", f"{s} hemisphere cortical gray matter volume", f"{h}PialTotal", (-1.0, f"{h}WhiteMatterTotal"))),
        _derived("Cortex", "CortexVol", "Total cortical gray matter volume", "lhCortex", "rhCortex"),
        _volume("CorpusCallosumVol", "CorpusCallosumVol", "Volume of the Corpus Callosum", range(251, 256)),
        *_sided(lambda h, s: Measure(f"{h}WM-hypointensities", f"{s}WhiteMatterHypoIntensities", f"Volume of {s} White matter hypointensities", MM3, "sided_label")),
        *_sided(lambda h, s: _derived(f"{h}CerebralWhiteMatter", f"{h}CerebralWhiteMatterVol", f"{s} hemisphere cerebral white matter volume", f"{h}WhiteMatterVol", f"{h}WM-hypointensities", (0.5, "CorpusCallosumVol"))),
        _derived("CerebralWhiteMatter", "CerebralWhiteMatterVol", "Total cerebral white matter volume", "rhCerebralWhiteMatter", "lhCerebralWhiteMatter"),
        _volume("CerebellarGM", "CerebellarGMVol", "Cerebellar gray matter volume", 8, 47, range(601, 629), range(630, 633)),
        _volume("CerebellarWM", "CerebellarWMVol", "Cerebellar white matter volume", 7, 46),
        _volume("SubCortGray", "SubCortGrayVol", "Subcortical gray matter volume", 17, 18, 26, 27, 28, 58, 59, 60, range(10, 14), range(49, 55)),
        _derived("TotalGray", "TotalGrayVol", "Total gray matter volume", "SubCortGray", "Cortex", "CerebellarGM"),
        _volume("TFFC", "Third-Fourth-Fifth-CSF", "volume of 3rd, 4th, 5th ventricle and CSF", 14, 15, 72, 24),
        _volume("VentricleChoroidVol", "VentricleChoroidVol", "Volume of ventricles and choroid plexus", 4, 5, 31, 43, 44, 63),
        _volume("BrainSeg", "BrainSegVol", "Brain Segmentation Volume", *_BRAIN, *_PARCELS),
        _derived("BrainSegNotVent", "BrainSegVolNotVent", "Brain Segmentation Volume Without Ventricles", "BrainSeg", (-1.0, "VentricleChoroidVol"), (-1.0, "TFFC")),
        _derived("BrainSegNotVentSurf", "BrainSegVolNotVentSurf", "Brain Segmentation Volume Without Ventricles", "BrainSeg", (-1.0, "VentricleChoroidVol"), (-1.0, "TFFC")),
        _derived("Cerebellum", "CerebellumVol", "Cerebellar volume", "CerebellarGM", "CerebellarWM"),
        _derived("SupraTentorial", "SupraTentorialVol", "Supratentorial volume", "BrainSeg", (-1.0, "Cerebellum")),
        _derived("SupraTentorialNotVent", "SupraTentorialVolNotVent", "Supratentorial volume", "SupraTentorial", (-1.0, "VentricleChoroidVol"), (-1.0, "TFFC")),
        _derived("SupraTentorialNotVentVox", "SupraTentorialVolNotVentVox", "Supratentorial volume voxel count", "SupraTentorialNotVent", kind="by_vox_vol"),
        Measure("Mask", "MaskVol", "Mask Volume", MM3, "mask"),
        Measure("EstimatedTotalIntraCranialVol", "eTIV", "Estimated Total Intracranial Volume", MM3, "etiv"),
        _derived("BrainSegVol-to-eTIV", "BrainSegVol-to-eTIV", "Ratio of BrainSegVol to eTIV", "BrainSeg", "EstimatedTotalIntraCranialVol", kind="ratio"),
        _derived("MaskVol-to-eTIV", "MaskVol-to-eTIV", "Ratio of MaskVol to eTIV", "Mask", "EstimatedTotalIntraCranialVol", kind="ratio"),
    ]
}
# Without cortical parcels the whole-brain measure lists structures only.
STRUCTURE_BRAIN = _volume("BrainSeg", "BrainSegVol", "Brain Segmentation Volume", *_BRAIN)

# Labels that mark the left side when unsided white-matter label 77 is split, and the share needed.
LEFT_MARKERS = [2, 4, 5, 7, 8, 10, 11, 12, 13, 17, 18, 26, 28, 30, 31]
LEFT_SHARE = 0.2


def unit_of(key: str, catalogue: dict[str, Measure] = CATALOGUE) -> str:
    """The stated unit, or the one that follows from the parents; clashing parent units are an error."""
    m = catalogue[key]
    if m.unit is not None:
        return m.unit
    units = [unit_of(k, catalogue) for _, k in m.parents]
    if m.kind == "sum" and units and len(set(units)) == 1:
        return units[0]
    if m.kind == "ratio" and len(units) == 2:
        if units[0] == units[1]:
            return UNITLESS
        if units[1] == UNITLESS:
            return units[0]
    if m.kind == "by_vox_vol" and units == [MM3]:
        return UNITLESS
    raise ValueError(f"units of {key} do not fit its operation: {units}")


def expand(key: str, catalogue: dict[str, Measure] = CATALOGUE) -> list[tuple[str, str, float]]:
    """Leaf coefficients (part, leaf key, factor) of a measure; parts are ``num`` and, for ratios, ``den``."""
    m = catalogue[key]
    if m.kind in ("sum", "by_vox_vol"):
        total: dict[str, float] = {}
        for factor, parent in m.parents:
            for part, leaf, f in expand(parent, catalogue):
                if part != "num":
                    raise ValueError(f"{key}: a sum cannot take the ratio {parent} as a parent")
                total[leaf] = total.get(leaf, 0.0) + factor * f
        return [("num", leaf, f) for leaf, f in total.items()]
    if m.kind == "ratio":
        if len(m.parents) != 2:
            raise ValueError(f"{key}: a ratio needs two parents")
        parts = []
        for part, (factor, parent) in zip(("num", "den"), m.parents, strict=True):
            parts += [(part, leaf, factor * f) for _, leaf, f in expand(parent, catalogue)]
        return parts
    return [("num", key, 1.0)]


def leaves(keys: Iterable[str], catalogue: dict[str, Measure] = CATALOGUE) -> list[str]:
    return sorted({leaf for k in keys for _, leaf, _ in expand(k, catalogue)})


def class_measures(partials: DataFrame, catalogue: dict[str, Measure] = CATALOGUE, keys: Sequence[str] | None = None) -> DataFrame:
    """All class volumes (``subject_id, key, value``) in one pass; classes that are absent count 0."""
    chosen = [m for m in catalogue.values() if m.kind == "classes" and (keys is None or m.key in keys)]
    members = literal_table(
        partials.sparkSession, [(m.key, c, m.unit == UNITLESS) for m in chosen for c in m.classes], "key string, seg int, as_count boolean"
    )
    value = F.when(F.col("as_count"), F.col("n_voxels").cast("double")).otherwise(F.col("volume"))
    sums = partials.join(members, "seg").groupBy(SUBJECT, "key").agg(F.sum(value).alias("value"))
    every = partials.select(SUBJECT).distinct().withColumn("key", F.explode(F.lit([m.key for m in chosen])))
    return every.join(sums, [SUBJECT, "key"], "left").fillna(0.0, subset=["value"])


def sided_measures(voxels: DataFrame, dims: DataFrame, headers: DataFrame, wanted: int = 77) -> DataFrame:
    """Volumes of an unsided label split into left and right (``subject_id, key, value``)."""
    sided = split_sided_label(voxels, dims, LEFT_MARKERS, wanted, LEFT_SHARE)
    counts = sided.groupBy(SUBJECT).agg(*(F.count_if(F.col("side") == s).alias(k) for s, k in (("left", "lh"), ("right", "rh"))))
    sized = headers.select(SUBJECT, "vox_vol").join(counts, SUBJECT, "left").fillna(0, subset=["lh", "rh"])
    rows = F.explode(F.array(*(F.struct(F.lit(f"{h}WM-hypointensities").alias("key"), (F.col(h) * F.col("vox_vol")).alias("value")) for h in ("lh", "rh"))))
    return sized.select(SUBJECT, rows.alias("r")).select(SUBJECT, "r.*")


# The surfaces that mesh measures are taken from.
HOLES_SURFACE, PIAL_SURFACE, WHITE_SURFACE = "orig.nofix", "pial", "white"


def mesh_measures(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Holes and enclosed volumes of the surfaces that the catalogue names (``subject_id, key, value``).

    Both tables carry ``hemi`` (lh, rh) and ``surface``; holes come from the surface before its defects were mended.
    """
    mesh = [SUBJECT, "hemi", "surface"]
    holes = euler_numbers(faces.filter(F.col("surface") == HOLES_SURFACE), mesh)
    holes = holes.select(SUBJECT, F.concat("hemi", F.lit("SurfaceHoles")).alias("key"), F.col("holes").cast("double").alias("value"))
    closed = F.col("surface").isin(PIAL_SURFACE, WHITE_SURFACE)
    volumes = enclosed_volume(faces.filter(closed), vertices.filter(closed), mesh)
    name = F.concat("hemi", F.when(F.col("surface") == PIAL_SURFACE, "PialTotal").otherwise("WhiteMatterTotal"))
    return holes.unionByName(volumes.select(SUBJECT, name.alias("key"), F.col("volume").alias("value")))


def catalogue_measures(
    segmentation: DataFrame, dims: DataFrame, headers: DataFrame, faces: DataFrame, vertices: DataFrame, mask: DataFrame, transforms: DataFrame,
    keys: Sequence[str] | None = None, catalogue: dict[str, Measure] = CATALOGUE,
) -> DataFrame:
    """Every measure of the catalogue from its sources: labels, sided labels, meshes, the mask and the atlas transform.

    ``segmentation`` has voxels with ``seg``, ``mask`` voxels with ``value`` (above 0 counts), ``transforms`` one 4x4 ``matrix`` per
    subject.  Leaves of all sources are one table; the definitions are unfolded to leaf coefficients and evaluated in one
    aggregate.  A subject that lacks a source has NULL for what follows from it.
    """
    leaf = ["subject_id", "key", "value"]
    partials = with_volume(segmentation.groupBy(SUBJECT, "seg").agg(F.count(F.lit(1)).alias("n_voxels")), headers)
    inside = mask_volume(mask, headers, F.col("value") > 0)
    parts = [
        class_measures(partials, catalogue),
        sided_measures(segmentation.select(*VOXEL, "seg"), dims, headers),
        mesh_measures(faces, vertices),
        inside.select(SUBJECT, F.lit("Mask").alias("key"), F.col("volume").alias("value")),
        transforms.select(SUBJECT, F.lit("EstimatedTotalIntraCranialVol").alias("key"), intracranial_volume("matrix").alias("value")),
    ]
    whole = ["lhSurfaceHoles", "rhSurfaceHoles"]
    values = parts[0].select(*leaf)
    for p in parts[1:]:
        values = values.unionByName(p.select(*leaf))
    values = materialize(values.withColumn("is_int", F.col("key").isin(whole)), "leaves")
    return derived_measures(values, list(catalogue) if keys is None else keys, headers, catalogue)


def derived_measures(
    values: DataFrame, keys: Sequence[str], headers: DataFrame, catalogue: dict[str, Measure] = CATALOGUE
) -> DataFrame:
    """Evaluate measures from leaf values (``subject_id, key, value[, is_int]``).

    The definition graph is unfolded to leaf coefficients on the driver; the data sees one join and one
    aggregate whatever the depth.  A measure with a missing leaf is NULL.
    """
    rows, wanted = [], []
    for k in keys:
        parts = expand(k, catalogue)
        rows += [(k, part, leaf, f) for part, leaf, f in parts]
        wanted.append((k, len(parts), catalogue[k].kind, all(float(f).is_integer() for _, _, f in parts), unit_of(k, catalogue), catalogue[k].name, catalogue[k].description))
    spark = values.sparkSession
    coefficients = literal_table(spark, rows, "out_key string, part string, key string, factor double")
    info = literal_table(
        spark, wanted, "out_key string, n_leaves int, kind string, whole boolean, unit string, name string, description string"
    )
    if "is_int" not in values.columns:
        values = values.withColumn("is_int", F.lit(False))
    term = F.col("factor") * F.col("value")
    sums = (
        values.join(coefficients, "key")
        .groupBy(SUBJECT, "out_key")
        .agg(
            F.sum(F.when(F.col("part") == "num", term)).alias("_num"),
            F.sum(F.when(F.col("part") == "den", term)).alias("_den"),
            F.count("value").alias("_got"),
            F.bool_and("is_int").alias("_ints"),
        )
    )
    joined = sums.join(info, "out_key").join(headers.select(SUBJECT, "vox_vol"), SUBJECT, "left")
    value = (
        F.when(F.col("_got") < F.col("n_leaves"), None)
        .when(F.col("kind") == "ratio", F.try_divide("_num", "_den"))
        .when(F.col("kind") == "by_vox_vol", F.try_divide("_num", "vox_vol"))
        .otherwise(F.col("_num"))
    )
    is_int = F.col("_ints") & F.col("whole") & ~F.col("kind").isin("ratio", "by_vox_vol")
    return joined.select(
        SUBJECT, F.col("out_key").alias("key"), "name", "description", value.alias("value"), is_int.alias("is_int"), "unit"
    )


def import_measures(computed: DataFrame, imported: DataFrame) -> DataFrame:
    """Add imported measures; one that was computed is never replaced."""
    both = computed.withColumn("_rank", F.lit(0)).unionByName(imported.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy(SUBJECT, "key").orderBy("_rank"))
    return both.withColumn("_first", first).filter("_first = 1").drop("_rank", "_first")


def intracranial_volume(matrix: str) -> Column:
    """Atlas scale over the determinant of the affine part."""
    return F.lit(ETIV_SCALE) / det3(matrix)

"""How well two label volumes agree: everything follows from one count per (truth, prediction) pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.operators.grid import erode
from volspark.operators.labels import VOXEL
from volspark.operators.nearest import nearest_points
from volspark.operators.regions import SUBJECT
from volspark.plans.ordered import exact_percentiles
from volspark.plans.storage import materialize


def confusion(pairs: DataFrame, truth: str = "seg", pred: str = "pred", by: Sequence[str] = (SUBJECT,)) -> DataFrame:
    return pairs.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def merged_counts(counts: DataFrame, groups: DataFrame, by: Sequence[str] = (SUBJECT,)) -> DataFrame:
    """:func:`class_counts` for groups of labels (``group_id``, ``member_id``), which may overlap."""
    t = groups.select(F.col("member_id").alias("truth"), F.col("group_id").alias("cls"))
    p = groups.select(F.col("member_id").alias("pred"), F.col("group_id").alias("cls"))
    zero = F.lit(0).cast("long")
    in_truth = counts.join(t, "truth").select(*by, "cls", zero.alias("tp"), F.col("n").alias("t"), zero.alias("p"))
    in_pred = counts.join(p, "pred").select(*by, "cls", zero.alias("tp"), zero.alias("t"), F.col("n").alias("p"))
    both = counts.join(t, "truth").join(p, ["pred", "cls"]).select(*by, "cls", F.col("n").alias("tp"), zero.alias("t"), zero.alias("p"))
    rows = in_truth.unionByName(in_pred).unionByName(both)
    return rows.groupBy(*by, "cls").agg(F.sum("tp").alias("tp"), F.sum("t").alias("n_truth"), F.sum("p").alias("n_pred"))


def class_counts(counts: DataFrame, by: Sequence[str] = (SUBJECT,), classes: Sequence[int] | None = None) -> DataFrame:
    """Per class: true positives ``tp``, ``n_truth``, ``n_pred``."""
    sides = F.explode(
        F.array(
            F.struct(F.col("truth").alias("cls"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")),
            F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")),
        )
    )
    rows = counts.select(*by, sides.alias("s")).select(*by, "s.*").filter(F.col("cls").isNotNull())
    if classes is not None:
        rows = rows.filter(F.col("cls").isin(list(classes)))
    return rows.groupBy(*by, "cls").agg(F.sum("tp").alias("tp"), F.sum("t").alias("n_truth"), F.sum("p").alias("n_pred"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def scores(per_class: DataFrame) -> DataFrame:
    """Dice, Dice dissimilarity, IoU, recall, precision and volume similarity per class; NULL for an empty class."""
    tp, t, p = F.col("tp"), F.col("n_truth"), F.col("n_pred")
    return (
        per_class.withColumn("union", t + p - tp)
        .withColumn("dice", _ratio(2 * tp, t + p))
        .withColumn("dissimilarity", 1 - F.col("dice"))
        .withColumn("iou", _ratio(tp, F.col("union")))
        .withColumn("recall", _ratio(tp, t))
        .withColumn("precision", _ratio(tp, p))
        .withColumn("volume_similarity", 1 - _ratio(F.abs(p - t), p + t))
    )


def dice_matrix(counts: DataFrame, by: Sequence[str] = (SUBJECT,)) -> DataFrame:
    """Dice of every pair of a true and a predicted class that both occur."""
    t = counts.groupBy(*by, "truth").agg(F.sum("n").alias("n_truth"))
    p = counts.groupBy(*by, "pred").agg(F.sum("n").alias("n_pred"))
    cells = t.join(p, list(by)).join(counts, [*by, "truth", "pred"], "left").fillna(0, subset=["n"])
    return cells.select(*by, "truth", "pred", _ratio(2 * F.col("n"), F.col("n_truth") + F.col("n_pred")).alias("dice"))


def mean_dice(per_class: DataFrame, by: Sequence[str] = (SUBJECT,)) -> DataFrame:
    return scores(per_class).groupBy(*by).agg(F.avg("dice").alias("mean_dice"))


def group_scores(per_class: DataFrame, group: str) -> DataFrame:
    """Mean IoU, recall and precision per group over classes other than background; counts are summed first."""
    rows = scores(per_class.filter(F.col("cls") != 0))
    return rows.groupBy(group).agg(F.avg("iou").alias("mean_iou"), F.avg("recall").alias("mean_recall"), F.avg("precision").alias("mean_precision"))


def final_score(per_class: DataFrame, group: str) -> DataFrame:
    """Mean over classes of the IoU summed over groups; it is not divided by the number of groups."""
    rows = scores(per_class.filter(F.col("cls") != 0))
    return rows.groupBy("cls").agg(F.sum("iou").alias("_s")).agg(F.avg("_s").alias("score"))


def wide_scores(per_class: DataFrame, names: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row per subject: a Dice column per class name and the mean without background."""
    rows = scores(per_class).filter(F.col("cls") != 0).join(names.select(F.col("id").alias("cls"), "label_name"), "cls")
    wide = rows.groupBy(SUBJECT).pivot("label_name", list(order)).agg(F.first("dice"))
    return wide.join(rows.groupBy(SUBJECT).agg(F.avg("dice").alias("mean")), SUBJECT)


def mean_squared_error(pairs: DataFrame, a: str, b: str, by: Sequence[str] = (SUBJECT,)) -> DataFrame:
    d = F.col(a) - F.col(b)
    return pairs.groupBy(*by).agg(F.avg(d * d).alias("mse"))


def surface(labels: DataFrame, dims: DataFrame, label: str) -> DataFrame:
    """Voxels of each label that one 6-neighbour erosion takes away."""
    mask = labels.filter(F.col(label) != 0).select(*VOXEL, F.col(label).alias("cls"))
    return mask.join(erode(mask, dims, 6, 1, ["cls"]), [*VOXEL, "cls"], "left_anti")


def surface_distances(labels: DataFrame, dims: DataFrame, truth: str = "seg", pred: str = "pred", spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Distance of every surface voxel of one volume to the same label's surface in the other, both ways."""
    place = F.shiftleft(F.col("x").cast("long"), 40) + F.shiftleft(F.col("y").cast("long"), 20) + F.col("z")
    sides = []
    for label in (truth, pred):
        scaled = [(F.col(a) * s).alias(a) for a, s in zip("xyz", spacing, strict=True)]
        sides.append(materialize(surface(labels, dims, label).select(SUBJECT, "cls", place.alias("id"), *scaled), "surface"))
    t, p = sides
    keys = [SUBJECT, "cls"]
    there = nearest_points(t.withColumnRenamed("id", "qid"), p.withColumnRenamed("id", "tid"), keys)
    back = nearest_points(p.withColumnRenamed("id", "qid"), t.withColumnRenamed("id", "tid"), keys)
    return there.select(*keys, "distance").unionAll(back.select(*keys, "distance"))


def hausdorff(labels: DataFrame, dims: DataFrame, truth: str = "seg", pred: str = "pred", spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Largest, median and 95th percentile surface distance per label; NULL for labels that one side lacks."""
    d = materialize(surface_distances(labels, dims, truth, pred, spacing), "distances")
    keys = [SUBJECT, "cls"]
    top = d.groupBy(*keys).agg(F.max("distance").alias("hd"))
    return top.join(exact_percentiles(d, keys, "distance", {"hd50": 0.5, "hd95": 0.95}), keys, "left")


# --- evaluation of class scores ----------------------------------------------------------------------


def soft_scores(logits: str) -> Column:
    """Softmax of an array of logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda s: F.exp(s - top))
    total = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / total)


def evaluate_losses(voxels: DataFrame, logits: str = "s", truth: str = "label", weight: str = "weight", eps: float = 0.001, by: Sequence[str] = (SUBJECT,)) -> DataFrame:
    """Soft Dice loss (mean over classes), mean weighted cross-entropy, and their sum."""
    rows = voxels.withColumn("_p", soft_scores(logits))
    ce = -F.log(F.element_at("_p", F.col(truth) + 1)) * F.col(weight)
    rows = rows.withColumn("_ce", ce)
    flat = rows.select(*by, truth, "_ce", F.posexplode("_p").alias("c", "p"))
    hit = F.when(F.col("c") == F.col(truth), 1.0).otherwise(0.0)
    per_class = flat.groupBy(*by, "c").agg(
        F.sum(F.col("p") * hit).alias("_i"),
        F.sum(F.col("p") + hit).alias("_u"),
        F.avg("_ce").alias("ce"),
    )
    dice = 1 - F.avg(2 * F.col("_i") / (F.col("_u") + eps))
    out = per_class.groupBy(*by).agg(dice.alias("dice_loss"), F.max("ce").alias("ce_loss"))
    return out.withColumn("loss", F.col("dice_loss") + F.col("ce_loss"))

"""Label-space maps held as tables (``src``, ``dst``): apply, reverse, chain, merge, pair by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.operators.regions import LABEL_SPACE
from volspark.plans.joins import attach
from volspark.plans.ordered import distinct_ranks


def map_labels(df: DataFrame, mapping: DataFrame, label: str = "seg", out: str | None = None, strict: bool = False) -> DataFrame:
    """Replace labels; an unmapped one becomes 0.  A label above the largest source is an error.

    ``strict`` (name keys) makes every unmapped label an error.
    """
    lookup = mapping.select(F.col("src").alias(label), F.col("dst").alias("_dst"))
    joined = attach(df, lookup, label, "left", costly=False)
    if strict:
        fail = F.raise_error(F.concat(F.lit("label without mapping: "), F.col(label).cast("string")))
        mapped = F.when(F.col("_dst").isNull(), fail.cast("string")).otherwise(F.col("_dst"))
    else:
        top = mapping.agg(F.max("src")).first()[0]
        fail = F.raise_error(F.concat(F.lit("label above the map: "), F.col(label).cast("string")))
        mapped = F.when(F.col(label) > top, fail.cast("int")).otherwise(F.coalesce("_dst", F.lit(0)))
    return joined.withColumn(out or label, mapped).drop("_dst")


def reverse_map(mapping: DataFrame, order: str = "src") -> DataFrame:
    """Targets become sources; of several sources of one target the last by ``order`` wins."""
    return mapping.groupBy(F.col("dst").alias("src")).agg(F.max_by(F.col("src"), F.col(order)).alias("dst"))


def bijective(mapping: DataFrame) -> DataFrame:
    """One row: whether no target has two sources."""
    return mapping.agg((F.count("dst") == F.count_distinct("dst")).alias("bijective"))


def chain_maps(first: DataFrame, second: DataFrame) -> DataFrame:
    """``second`` after ``first``; every target of the first must be a source of the second."""
    gap = first.join(second.select(F.col("src").alias("dst")), "dst", "left_anti").select("dst").distinct()
    missing = gap.agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("low"), F.max("dst").alias("high")).first()
    if missing["n"]:
        raise ValueError(f"{missing['n']} targets without a source in the second map, from {missing['low']} to {missing['high']}")
    nxt = second.select(F.col("src").alias("dst"), F.col("dst").alias("_end"))
    return first.join(nxt, "dst").select("src", F.col("_end").alias("dst"))


def merge_maps(base: DataFrame, update: DataFrame, overwrite: bool = True) -> DataFrame:
    both = base.select("src", F.col("dst").alias("_a")).join(update.select("src", F.col("dst").alias("_b")), "src", "full")
    first, second = ("_b", "_a") if overwrite else ("_a", "_b")
    return both.select("src", F.coalesce(first, second).alias("dst"))


def class_map(mapping: DataFrame, keep: Sequence[int] = (), compress: bool = False) -> DataFrame:
    """Label-space map plus kept labels; compressed targets are the 0-based rank of the distinct targets.

    Kept labels map to themselves, and are added only if some target is not among them.
    """
    out = mapping
    if keep:
        other = ~F.col("dst").isin(list(keep))
        if out.filter(other).limit(1).count():
            kept = F.explode(F.lit(list(keep)).cast("array<int>"))
            added = out.sparkSession.range(1).select(kept.alias("src")).withColumn("dst", F.col("src"))
            out = out.filter(~F.col("src").isin(list(keep))).unionByName(added)
    elif out.limit(1).count() == 0:
        return out
    if compress:
        ranked = distinct_ranks(out, "dst", "_rank")
        out = out.join(ranked, "dst").select("src", F.col("_rank").alias("dst"))
    return out


def position_map(labels: DataFrame, order: str = "id") -> DataFrame:
    """Label list position (0-based) to label: ``src`` = position, ``dst`` = label."""
    return distinct_ranks(labels, order, "src").select("src", F.col(order).cast("int").alias("dst"))


def pair_sides(lut: DataFrame, first: str = "Left-", second: str = "Right-") -> DataFrame:
    """Ids of structures whose names differ only by the two prefixes: ``src`` (first side), ``dst`` (second side)."""
    name = F.col("label_name")

    def side(prefix: str, out: str) -> DataFrame:
        bare = F.substr(name, F.lit(len(prefix) + 1))
        return lut.filter(name.startswith(prefix)).select(F.col("id").alias(out), bare.alias("_name"))

    return side(first, "src").join(side(second, "dst"), "_name").select("src", "dst")


def without_prefixes(lut: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    out = lut
    for p in prefixes:
        out = out.filter(~F.col("label_name").startswith(p))
    return out


def join_by_name(first: DataFrame, second: DataFrame) -> DataFrame:
    """Map the ids of one lookup table to those of another through equal names."""
    a = first.select(F.col("id").alias("src"), "label_name")
    b = second.select(F.col("id").alias("dst"), "label_name")
    return a.join(b, "label_name").select("src", "dst")


def same_names(first: DataFrame, second: DataFrame) -> DataFrame:
    """Map ids of two tables row by row (``pos``); differing names are an error."""
    b = second.select("pos", F.col("id").alias("dst"), F.col("label_name").alias("_other"))
    joined = first.select("pos", F.col("id").alias("src"), "label_name").join(b, "pos", "full")
    bad = joined.filter(~F.equal_null("label_name", "_other")).limit(1).collect()
    if bad:
        raise ValueError(f"lookup tables differ at row {bad[0]['pos']}")
    return joined.select("src", "dst")


def full_to_sagittal(df: DataFrame, sides: DataFrame, positions: DataFrame, label: str = "seg", out: str = "position") -> DataFrame:
    """Right parcels lose their side, left structures take the right id, then ids become list positions.

    A label missing from the sagittal list is an error.
    """
    work = df.withColumn("_fused", F.when(F.col(label).between(2000, 2999), F.col(label) - 1000).otherwise(F.col(label)))
    pairs = sides.select(F.col("src").alias("_fused"), F.col("dst").alias("_side"))
    work = attach(work, pairs, "_fused", costly=False).withColumn("_id", F.coalesce("_side", "_fused"))
    where = positions.select(F.col("dst").alias("_id"), F.col("src").alias(out))
    work = attach(work, where, "_id", costly=False)
    missing = F.raise_error(F.concat(F.lit("label not in the list: "), F.col("_id").cast("string")))
    return work.withColumn(out, F.when(F.col(out).isNull(), missing.cast("int")).otherwise(F.col(out))).drop("_fused", "_side", "_id")


# Class order of the three sagittal class spaces (96, 51 and 21 classes) in full label order.
SAGITTAL_GATHER = {
    96: [[0], range(5, 14), range(1, 4), [14, 15, 4], range(16, 19), range(5, 51), range(20, 51)],
    51: [
        [0], range(5, 14), range(1, 4), [14, 15, 4], range(16, 19), range(5, 51),
        [20, 22, 27], range(29, 32), [33, 34], range(38, 43), [45],
    ],
    21: [[0], range(5, 15), range(1, 4), [15, 16, 4], range(17, 20), range(5, 21)],
}


def gather_index(classes: int) -> list[int]:
    return [i for part in SAGITTAL_GATHER[classes] for i in part]


def gather_scores(scores: str, index: Sequence[int]) -> Column:
    """Scores in another class order: out[i] = scores[index[i]]."""
    return F.transform(F.lit(list(index)).cast("array<int>"), lambda i: F.get(F.col(scores), i))


def infer_index(labels: DataFrame, sagittal: DataFrame, remap: DataFrame) -> DataFrame:
    """Index of each full label in the sagittal list: itself, else label - 1000, else its paired label.

    ``labels`` and ``sagittal`` are (pos, id); ``remap`` is (src, dst).
    """
    s = sagittal.select(F.col("id").alias("_k"), F.col("pos").alias("_p"))
    out = labels
    for step, key in enumerate((F.col("id"), F.col("id") - 1000)):
        out = out.withColumn("_k", key).join(s, "_k", "left").withColumnRenamed("_p", f"_p{step}").drop("_k")
    paired = remap.select(F.col("src").alias("id"), F.col("dst").alias("_k")).join(s, "_k").select("id", F.col("_p").alias("_p2"))
    out = out.join(paired, "id", "left")
    return out.select("pos", "id", F.coalesce("_p0", "_p1", "_p2").alias("index"))


def map_scores(scores: DataFrame, mapping: DataFrame, key: Sequence[str], mode: str = "prob", reverse: bool = False) -> DataFrame:
    """Move class scores (``key``, ``c``, ``s``) through a class map.

    Several sources of one target are added (``prob``) or multiplied (``logit``).  Reversed, a class
    that spreads to n targets gives each the share s/n or the power s^(1/n).  Classes below the largest
    target that receive nothing are 0.
    """
    if mode not in ("prob", "logit"):
        raise ValueError("mode must be prob or logit")
    pairs = mapping.select("src", "dst")
    if reverse:
        pairs = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    fan = pairs.groupBy("src").agg(F.collect_list("dst").alias("_targets"))
    spread = attach(scores, fan.withColumnRenamed("src", "c"), "c", "inner", costly=False)
    n = F.size("_targets") if reverse else F.lit(1)
    s = F.col("s") / n if mode == "prob" else F.pow(F.col("s"), 1.0 / n)
    moved = spread.select(*key, F.explode("_targets").alias("c"), s.alias("s"))
    joined = F.sum("s") if mode == "prob" else F.product("s")
    sums = moved.groupBy(*key, "c").agg(joined.alias("s"))
    # classes below the largest target that no source has: an anti join, joined to the voxels by their mere presence
    space = pairs.agg(F.max("dst").cast("int").alias("_top")).select(F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("c"))
    absent = space.join(pairs.select(F.col("dst").cast("int").alias("c")), "c", "left_anti")
    absent = absent.agg(F.collect_list("c").alias("_absent")).withColumn("_all", F.lit(1))
    zeros = attach(scores.select(*key).distinct().withColumn("_all", F.lit(1)), absent, "_all", "inner")
    return sums.unionByName(zeros.select(*key, F.explode("_absent").alias("c"), F.lit(0.0).alias("s")))


def colour_index(present: DataFrame, lut: DataFrame) -> DataFrame:
    """Compact 0-based index and rgb in 0..1 of the labels that occur."""
    rows = lut.join(present.select(F.col("seg").alias("id")).distinct(), "id")
    ranks = distinct_ranks(rows, "id", "color_index")
    return rows.join(ranks, "id").select("id", "color_index", *((F.col(c) / 255.0).alias(c) for c in "rgb"))


def stack_tables(tables: DataFrame, suffix: Column, drop_unknown: bool = True) -> DataFrame:
    """Colour tables (``table_id``, ``pos``, ``id``, ``label_name``) under one another with a name suffix.

    Row 0 is dropped only where it is called ``unknown``.
    """
    rows = tables
    if drop_unknown:
        rows = rows.filter(~((F.col("pos") == 0) & (F.col("label_name") == "unknown")))
    return rows.withColumn("label_name", F.concat("label_name", suffix))

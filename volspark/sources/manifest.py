"""Lists of subjects and images, and the slab store of training slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.operators.regions import SUBJECT
from volspark.sources.tables import last_part


def subject_of(path: str, suffix: str = "") -> Column:
    """Subject name: the last path part once ``suffix`` is taken off the path."""
    p = F.col(path)
    bare = F.when(p.endswith(suffix), F.substring(p, F.lit(1), F.length(p) - len(suffix))).otherwise(p) if suffix else p
    return F.element_at(F.split(F.rtrim(bare, F.lit("/")), "/"), -1)


def absolute(path: str, base: str | None) -> Column:
    """Listed paths as they are when absolute, under ``base`` otherwise (an error without one)."""
    p = F.col(path)
    rooted = p.startswith("/") | p.rlike("^[a-z][a-z0-9+]*://")
    if base is None:
        return F.when(rooted, p).otherwise(F.raise_error(F.concat(F.lit("relative path needs a base folder: "), p)).cast("string"))
    return F.when(rooted, p).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), p))


def subject_manifest(
    spark: SparkSession, list_file: str | None = None, single: str | None = None, folder: str | None = None, glob: str = "*",
    base: str | None = None, suffix: str = "",
) -> DataFrame:
    """``subject_id, path`` from a list file, else one path, else the files of a folder."""
    if list_file is not None:
        rows = spark.read.text(list_file).filter(F.trim("value") != "").select(F.trim("value").alias("path"))
        rows = rows.select(absolute("path", base).alias("path"))
    elif single is not None:
        rows = spark.createDataFrame([(single,)], "path string")
    elif folder is not None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
        rows = files.select("path")
    else:
        raise ValueError("give a list file, a path or a folder")
    return rows.select(subject_of("path", suffix).alias(SUBJECT), "path")


def common_suffix(paths: DataFrame, path: str = "path") -> DataFrame:
    """Longest common suffix: that of the smallest and the largest reversed path, which bound all others."""
    ends = paths.agg(F.min(F.reverse(path)).alias("a"), F.max(F.reverse(path)).alias("b"))
    longest = F.least(F.length("a"), F.length("b"))
    sizes = F.filter(
        F.sequence(F.lit(0), longest), lambda n: F.substring(F.col("a"), F.lit(1), n) == F.substring(F.col("b"), F.lit(1), n)
    )
    return ends.select(F.reverse(F.substring(F.col("a"), F.lit(1), F.array_max(sizes))).alias("suffix"))


# A word of a batch line: quoted, escaped and bare parts that touch are one word.
_PART = r"""\\(?s:.)|[^'"\s\\]++|'[^']*'|"(?:[^"\\]|\\(?s:.))*+\""""
_WORD = f"(?:{_PART})++"


def split_words(text: Column) -> Column:
    """Words of a line by quoting rules: ``a"b c"d`` is the word ``ab cd``; an open quote or a lone ``\\`` at the end is an error."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    rest = F.trim(F.regexp_replace(F.regexp_replace(text, _WORD, ""), r"\s+", ""))
    bad = F.raise_error(F.concat(F.lit("could not parse the line, maybe incorrect quoting or escaping: "), text)).cast("array<string>")
    escapes = lambda p: F.regexp_replace(p, r"(?s)\\(.)", "$1")
    bare = lambda p: (
        F.when(p.startswith("'"), F.substring(p, F.lit(2), F.length(p) - 2)).when(p.startswith('"'), escapes(F.substring(p, F.lit(2), F.length(p) - 2))).otherwise(escapes(p))
    )
    joined = F.transform(words, lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(_PART), F.lit(0)), bare), ""))
    return F.when(rest == "", joined).otherwise(bad)


def parse_batch_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``id=path [arguments]`` lines: the first ``=`` splits, later ones stay; path and arguments go by quoting rules."""
    halves = F.split(F.col(line), "=", 2)
    keep = [c for c in lines.columns if c != line]
    rows = lines.filter(F.contains(F.col(line), F.lit("="))).withColumn("_w", split_words(F.get(halves, F.lit(1))))
    return rows.select(*keep, F.get(halves, F.lit(0)).alias("id"), F.get("_w", F.lit(0)).alias("path"), F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))).alias("args"))


def parse_pairings(lines: DataFrame, line: str = "line") -> DataFrame:
    """``fixed,mov1,mov2...`` lines as one row per pair with the folder name ``mov_to_fixed``."""
    parts = F.split(F.col(line), r"\s*,\s*")
    keep = [c for c in lines.columns if c != line]
    rows = lines.select(*keep, parts[0].alias("fixed"), F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("pos", "moving"))
    return rows.withColumn("folder", F.concat("moving", F.lit("_to_"), "fixed"))


def pair_time_points(time_points: DataFrame, templates: DataFrame) -> DataFrame:
    """Time points with the template they belong to (``base_id``)."""
    return time_points.join(templates, "base_id")


def write_slabs(slabs: DataFrame, path: str) -> None:
    slabs.write.partitionBy("plane", "size").parquet(path)


def read_slabs(spark: SparkSession, path: str, plane: str, sizes: Sequence[int]) -> DataFrame:
    """Slices of the wanted sizes, read from their folders only; sizes that do not exist are skipped."""
    return spark.read.parquet(path).filter((F.col("plane") == plane) & F.col("size").isin(list(sizes)))


def append_status(rows: DataFrame, path: str) -> None:
    """Add quality or status rows to an append-only table."""
    rows.write.mode("append").parquet(path)


__all__ = [
    "absolute", "append_status", "common_suffix", "last_part", "pair_time_points", "parse_batch_lines", "parse_pairings",
    "read_slabs", "subject_manifest", "subject_of", "write_slabs",
]

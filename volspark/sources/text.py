"""Text files as tables of numbered lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volspark.plans.joins import attach


def numbered_lines(spark: SparkSession, paths: str | Sequence[str], suffix: str | None = None) -> DataFrame:
    """``file, line_no, line`` of text files of any size, lines counted from 1.

    A large file is read in splits.  Lines are ranked inside their split and shifted by the line counts of
    the splits before it, so no task sees a whole file.
    """
    reader = spark.read
    if suffix is not None:
        reader = reader.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true")
    raw = reader.text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("line"),
    )
    sizes = raw.groupBy("file", "_split").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "_split", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("file", "_split").orderBy("_at")
    ranked = raw.withColumn("_rank", F.row_number().over(inside))
    out = attach(ranked, starts, ["file", "_split"])
    return out.select("file", (F.col("_before") + F.col("_rank")).cast("int").alias("line_no"), "line")


def small_text_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, line_no, line`` of many small files (each fits a row), without a shuffle."""
    whole = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    rows = whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("p", "line"))
    return rows.select("file", (F.col("p") + 1).alias("line_no"), "line")

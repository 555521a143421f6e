"""Lookup tables, statistics files, measures and transforms: text formats in and out of DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from volspark.operators.regions import SUBJECT

LUT_COLUMNS = ("id", "label_name", "r", "g", "b", "a")
# Column names of a statistics table; the last five take the intensity image's name as prefix.
STAT_HEADERS = ("Index", "SegId", "NVoxels", "Volume_mm3", "StructName", "Mean", "StdDev", "Min", "Max", "Range")
INTENSITY_HEADERS = STAT_HEADERS[5:]
# Descriptions and units of the columns, as the file header states them.
COLUMN_TEXT = {
    "Index": ("Index", "NA"),
    "SegId": ("Segmentation Id", "NA"),
    "NVoxels": ("Number of Voxels", "unitless"),
    "Volume_mm3": ("Volume", "mm^3"),
    "StructName": ("Structure Name", "NA"),
}


# --- lookup tables -----------------------------------------------------------------------------------


def parse_lut(lines: DataFrame, kind: str) -> DataFrame:
    """Rows of a lookup table from text lines: ``txt`` by white space, ``csv`` by comma, ``tsv`` by tab with a header row."""
    text = F.trim("line")
    rows = lines.filter((text != "") & ~text.startswith("#"))
    pattern = {"txt": r"\s+", "csv": r"\s*,\s*", "tsv": "\t"}
    if kind not in pattern:
        raise ValueError(f"unknown kind of lookup table: {kind}")
    parts = F.split(text, pattern[kind])
    if kind == "tsv":
        rows = rows.filter(~F.lower(F.get(parts, F.lit(0))).isin("id", "no", "index"))
    numbers = [F.try_element_at(parts, F.lit(i + 1)).cast("int").alias(n) for i, n in enumerate(LUT_COLUMNS) if n != "label_name"]
    name = F.get(parts, F.lit(1)).alias("label_name")
    keep = [c for c in lines.columns if c not in ("line", "line_no")]
    return rows.select(*keep, numbers[0], name, *numbers[1:])


def read_lut(spark: SparkSession, path: str) -> DataFrame:
    return parse_lut(spark.read.text(path).withColumnRenamed("value", "line"), path.rsplit(".", 1)[-1])


def parse_json_lut(texts: DataFrame, column: str = "value") -> DataFrame:
    """``src, dst`` of the object under ``labels``, one text per row."""
    labels = F.from_json(F.get_json_object(column, "$.labels"), MapType(StringType(), StringType()))
    keep = [c for c in texts.columns if c != column]
    return texts.select(*keep, F.explode(labels).alias("src", "dst"))


def read_json_lut(spark: SparkSession, path: str) -> DataFrame:
    return parse_json_lut(spark.read.text(path, wholetext=True))


# --- measures ----------------------------------------------------------------------------------------


def format_measures(measures: DataFrame, decimals: int = 6) -> DataFrame:
    """``line``: ``# Measure key, name, description, value, unit``; whole-number measures are written without decimals."""
    value = F.when(F.col("is_int"), F.format_string("%d", F.col("value").cast("long"))).otherwise(
        F.format_string(f"%.{decimals}f", F.col("value"))
    )
    line = F.concat(F.lit("# Measure "), F.concat_ws(", ", "key", "name", "description", value, "unit"))
    return measures.withColumn("line", line)


def parse_measures(lines: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """Measures of statistics text; the last ``VoxelVolume_mm3`` line becomes the measure ``vox_vol``."""
    text = F.regexp_extract("line", r"^\s*#\s*Measure\s+(.*)$", 1)
    parts = F.split(F.trim(text), r"\s*,\s*")
    rows = lines.filter(text != "").withColumn("_p", parts).filter(F.size("_p") == 5)
    value = F.col("_p")[3]
    measures = rows.select(
        *by, F.col("_p")[0].alias("key"), F.col("_p")[1].alias("name"), F.col("_p")[2].alias("description"),
        value.cast("double").alias("value"), (~F.contains(value, F.lit("."))).alias("is_int"), F.col("_p")[4].alias("unit"),
    )
    found = F.regexp_extract("line", r"^\s*#\s*VoxelVolume_mm3\s+(\S+)", 1)
    vox = lines.filter(found != "").groupBy(*by).agg(F.max_by(found, F.col("line_no")).cast("double").alias("value"))
    vox = vox.select(
        *by, F.lit("vox_vol").alias("key"), F.lit("Voxel volume").alias("name"), F.lit("The volume of a voxel").alias("description"),
        "value", F.lit(False).alias("is_int"), F.lit("mm^3").alias("unit"),
    )
    return measures.unionByName(vox)


# --- statistics tables -------------------------------------------------------------------------------


def _header(name: str, norm: str) -> str:
    return norm + name if name in INTENSITY_HEADERS else name


def stat_lines(stats: DataFrame, headers: DataFrame, measures: DataFrame | None = None, norm: str = "norm", unit: str = "MR",
               precision: int = 1, exclude: Sequence[int] = (), only_filled: bool = True, legacy: bool = False) -> DataFrame:
    """Text of one statistics file per subject: ``subject_id, line_no, line``.

    ``stats`` is a region table as :func:`volspark.operators.regions.region_stats` makes it.
    """
    body_line = F.format_string(
        f"%3d %3d %9d %10.{precision}f  %-30s %10.4f %10.4f %10.4f %10.4f %10.4f",
        "row_index", "seg", "n_voxels", "volume", "struct_name", "v_mean", F.coalesce("v_std", F.lit(float("nan"))), "v_min", "v_max", "v_range",
    )
    body = stats.select(SUBJECT, (F.lit(1_000_000) + F.col("row_index")).alias("_at"), body_line.alias("line"))
    fixed = ["# Title Segmentation Statistics", "#"]
    if exclude:
        fixed.append("# ExcludeSegId " + " ".join(map(str, exclude)))
    if only_filled:
        fixed.append("# Only reporting non-empty segmentations")
    columns = []
    for i, name in enumerate(STAT_HEADERS, 1):
        text, u = COLUMN_TEXT.get(name, (f"Intensity {_header(name, norm)}", unit))
        columns += [f"# TableCol {i:>2d} ColHeader {_header(name, norm)}", f"# TableCol {i:>2d} FieldName {text}", f"# TableCol {i:>2d} Units     {u}"]
    head = headers.select(SUBJECT, "vox_vol").join(stats.groupBy(SUBJECT).agg(F.count(F.lit(1)).alias("_rows")), SUBJECT)
    texts = F.array(
        *(F.lit(t) for t in fixed),
        F.lit("# compatibility: " + ("legacy" if legacy else "fixed")),
        F.concat(F.lit("# VoxelVolume_mm3 "), F.col("vox_vol").cast("string")),
    )
    tail = F.array(
        *(F.lit(t) for t in columns),
        F.format_string("# NRows %2d", "_rows"),
        F.lit(f"# NTableCols {len(STAT_HEADERS):>2d}"),
        F.lit("# ColHeaders  " + " ".join(_header(n, norm) for n in STAT_HEADERS)),
    )
    top = head.select(SUBJECT, F.posexplode(texts).alias("_at", "line"))
    low = head.select(SUBJECT, F.posexplode(tail).alias("_p", "line")).select(SUBJECT, (F.col("_p") + 500_000).alias("_at"), "line")
    parts = top.unionByName(low).unionByName(body)
    if measures is not None:
        order = F.row_number().over(Window.partitionBy(SUBJECT).orderBy("key"))
        parts = parts.unionByName(format_measures(measures).select(SUBJECT, (order + 1_000).alias("_at"), "line"))
    at = F.row_number().over(Window.partitionBy(SUBJECT).orderBy("_at"))
    return parts.select(SUBJECT, at.alias("line_no"), "line")


def write_stat_files(lines: DataFrame, path: str) -> None:
    """One folder per subject, lines in order."""
    ordered = lines.repartition(SUBJECT).sortWithinPartitions(SUBJECT, "line_no")
    ordered.select(SUBJECT, "line").write.partitionBy(SUBJECT).text(path)


def parse_stat_table(lines: DataFrame, by: Sequence[str] = ("file",), norm: str = "norm") -> DataFrame:
    """Cells of statistics text by the names in its last ``# ColHeaders`` line: long rows ``row_no, column, text``."""
    names = F.regexp_extract("line", r"^#\s*ColHeaders\s+(.*)$", 1)
    heads = lines.filter(names != "").groupBy(*by).agg(F.max_by(names, F.col("line_no")).alias("_h"))
    heads = heads.select(*by, F.split(F.trim("_h"), r"\s+").alias("_h"))
    rows = lines.filter(~F.trim("line").startswith("#") & (F.trim("line") != ""))
    met = rows.join(heads, list(by)).withColumn("_c", F.split(F.trim("line"), r"\s+"))
    cells = met.select(*by, F.col("line_no").alias("row_no"), F.explode(F.arrays_zip("_h", "_c")).alias("_z"))
    return cells.select(*by, "row_no", F.col("_z._h").alias("column"), F.col("_z._c").alias("text"))


def stat_table(lines: DataFrame, by: Sequence[str] = ("file",), norm: str = "norm") -> DataFrame:
    """:func:`parse_stat_table` as typed columns."""
    wanted = [_header(n, norm) for n in STAT_HEADERS]
    wide = parse_stat_table(lines, by, norm).groupBy(*by, "row_no").pivot("column", wanted).agg(F.first("text"))
    kinds = {"Index": "int", "SegId": "int", "NVoxels": "bigint", "StructName": "string"}
    return wide.select(*by, *(F.col(n).cast(kinds.get(n, "double")).alias(n) for n in wanted))


# --- transforms --------------------------------------------------------------------------------------


def parse_xfm(lines: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """4x4 matrix ``m`` from the three lines after the ``linear_...`` line; the last row is fixed."""
    mark = F.lower("line").startswith("linear_")
    start = lines.filter(mark).groupBy(*by).agg(F.min("line_no").alias("_start"))
    rows = lines.join(start, list(by)).filter((F.col("line_no") > F.col("_start")) & (F.col("line_no") <= F.col("_start") + 3))
    numbers = F.transform(F.split(F.trim(F.regexp_replace("line", ";", " ")), r"\s+"), lambda t: t.cast("double"))
    grouped = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("line_no", numbers.alias("v")))).alias("_r"))
    last = F.array(F.array(*(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0))))
    return grouped.select(*by, F.concat(F.transform("_r", lambda r: r["v"]), last).alias("m"))


def parse_lta(lines: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """4x4 matrix ``m`` from the four number rows after the ``1 4 4`` line."""
    text = F.trim("line")
    start = lines.filter(text.rlike(r"^1\s+4\s+4$")).groupBy(*by).agg(F.min("line_no").alias("_start"))
    rows = lines.join(start, list(by)).filter((F.col("line_no") > F.col("_start")) & (F.col("line_no") <= F.col("_start") + 4))
    numbers = F.transform(F.split(text, r"\s+"), lambda t: t.cast("double"))
    grouped = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("line_no", numbers.alias("v")))).alias("_r"))
    return grouped.select(*by, F.transform("_r", lambda r: r["v"]).alias("m"))


def last_part(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)

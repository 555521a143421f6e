"""Cutting lineage by writing tables into the shared checkpoint folder.

Iterative operators read their last step many times.  Writing it as Parquet into the folder named by
``spark.checkpoint.dir`` keeps the result when an executor is lost, and gives the next join real file
sizes to plan with.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

_FOLDER_CONF = "spark.checkpoint.dir"


# Temporary folders of local sessions without the setting, by application.
_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, as the session names it.

    A session without the setting gets one only when it runs in a single local JVM, where the driver's
    disk is every task's disk.
    """
    folder = spark.conf.get(_FOLDER_CONF, None) or spark.sparkContext.getConf().get(_FOLDER_CONF)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {_FOLDER_CONF} to a folder that every executor can reach")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_folders[context.applicationId]


def _bytes_of(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in a row; nulls count 8."""
    if isinstance(kind, StringType | BinaryType):
        size = F.octet_length(value) + 16
    elif isinstance(kind, ArrayType) and not isinstance(kind.elementType, ArrayType | MapType | StringType | BinaryType):
        width = 8 * len(kind.elementType.fields) if isinstance(kind.elementType, StructType) else 8
        size = F.size(value) * width + 24
    elif isinstance(kind, ArrayType | MapType):
        size = F.octet_length(F.to_json(value)) + 24
    elif isinstance(kind, StructType):
        size = sum((_bytes_of(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    else:
        return F.lit(8)
    return F.coalesce(size, F.lit(8))


def row_bytes(schema: StructType) -> Column:
    return sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in schema.fields), F.lit(16)).cast("long")


def measured(df: DataFrame, tag: str = "step", **measures: Column) -> tuple[DataFrame, dict]:
    """Write ``df`` once; return it as a plain scan with its row count (``rows``) and further aggregates.

    The numbers are observed while writing, so they cost no extra job.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/volspark/{tag}-{uuid.uuid4().hex}"
    seen = Observation()
    totals = F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(df.schema)).alias("_bytes")
    df.observe(seen, *totals, *(m.alias(n) for n, m in measures.items())).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    numbers = dict(seen.get)
    out._volspark_rows, out._volspark_bytes = numbers["rows"], numbers.pop("_bytes") or 0
    return out, numbers


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write ``df`` once and return it as a plain table scan."""
    return measured(df, tag)[0]


def known_rows(df: DataFrame) -> int | None:
    """Row count of a table written here; None for any other DataFrame."""
    return df.__dict__.get("_volspark_rows")


def known_bytes(df: DataFrame) -> int | None:
    """About the bytes of the rows of a table written here; None for any other DataFrame."""
    return df.__dict__.get("_volspark_bytes")


def release(df: DataFrame | None) -> None:
    """Delete the files of a table made by :func:`materialize` that nothing reads any more."""
    if df is None:
        return
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    folders = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    for folder in folders:
        if "/volspark/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)

"""Session defaults for local work; a cluster passes its own session in."""

import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", app: str = "volspark", partitions: int = 8, checkpoint: str | None = None) -> SparkSession:
    """A session in one local JVM; ``checkpoint`` is the folder for intermediate tables, else a new one below /tmp."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", checkpoint or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )

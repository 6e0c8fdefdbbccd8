"""Session construction for local runs, tests and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC, adaptive execution with skew handling, and nothing that a cluster would not also set.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", app: str = "diffmill") -> SparkSession:
    """A local session; on a cluster, pass the session that the cluster gives instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=DEFAULTS)
    builder = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

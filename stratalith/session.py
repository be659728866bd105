"""Session defaults. Cluster settings given by the caller always win."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.showConsoleProgress": "false",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session for tests and the local bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory)
    for key, value in (DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus)} | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

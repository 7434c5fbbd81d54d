"""The session the library expects: UTC, adaptive execution, Arrow."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(cpus: int | str = "*", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the one spark-submit gives."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("textloom")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions or 8),
        "spark.driver.memory": os.environ.get("TEXTLOOM_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

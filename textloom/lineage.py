"""Cutting lineage in loops: checkpoint into the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder does for a local master, whose executors are the
    driver; on a cluster it is an error, as they don't share one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not found and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="textloom-"))
    return found or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()

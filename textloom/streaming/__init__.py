"""Structured Streaming forms of operators that make sense on unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_word_count(lines: DataFrame) -> DataFrame:
    """word, count over a stream (or table) with a column value; complete or update mode."""
    words = lines.select(F.explode(F.split(F.lower("value"), r"[^a-z0-9]+")).alias("word")).where("word <> ''")
    return words.groupBy("word").count()


def upsert_into(store, name: str, key: str = "key"):
    """A foreachBatch sink that merges each micro-batch into a wide-row table, the latest value winning."""

    def merge(batch: DataFrame, _: int) -> None:
        store.put(name, batch, key)

    return merge

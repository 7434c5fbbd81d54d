"""Bags of strings and of pairs, as DataFrames.

Every operator takes Column functions (Catalyst plans them) or, where a name ends in ``_python``, a
Python callable over Arrow batches. Elements are kept as often as they occur; order is no contract.
Functions of folds are Column functions too; sum, min, max and the like have their own fast methods,
which aggregate before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.lineage import checkpointed

#: Elements that are folded at once: a power of two.
FOLDED = 4096


class Destroyed(RuntimeError):
    """A dataset was used after destroy()."""


class _Held:
    def __init__(self, df: DataFrame) -> None:
        self._df = df

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            raise Destroyed
        return self._df

    def destroy(self) -> None:
        """Give up the data; later use raises."""
        self.df.unpersist()
        self._df = None

    def persist(self):
        self.df.persist()
        return self

    def count(self) -> int:
        return self.df.count()


class Dataset(_Held):
    """A bag of strings: one column, value."""

    @classmethod
    def parallelize(cls, spark: SparkSession, values: Iterable[str]) -> "Dataset":
        return cls(spark.createDataFrame([(v,) for v in values], "value string"))

    @classmethod
    def from_table(cls, table: DataFrame, of: Column) -> "Dataset":
        """One element per row; null drops the row."""
        return cls(table.select(of.cast("string").alias("value")).where("value is not null"))

    def collect(self) -> list[str]:
        return [r["value"] for r in self.df.collect()]

    def take(self, n: int) -> list[str]:
        if n < 0:
            raise ValueError(n)
        return [r["value"] for r in self.df.limit(n).collect()]

    def save_as_table(self, store, name: str) -> DataFrame:
        return store.save(name, self.df)

    def flat_map(self, of: Callable[[Column], Column]) -> "Dataset":
        """of gives an array per element; a null array or item gives nothing."""
        return Dataset(self.df.select(F.explode(of(F.col("value")).cast("array<string>")).alias("value")).where("value is not null"))

    def flat_map_to_pair(self, of: Callable[[Column], Column]) -> "PairDataset":
        """of gives an array of struct<key, value> per element."""
        return PairDataset(self.df.select(F.explode(of(F.col("value"))).alias("p")).select("p.key", "p.value"))

    def map_to_pair(self, key: Callable[[Column], Column], value: Callable[[Column], Column]) -> "PairDataset":
        return PairDataset(self.df.select(key(F.col("value")).alias("key"), value(F.col("value")).alias("value")).where("key is not null"))

    def filter(self, keep: Callable[[Column], Column]) -> "Dataset":
        return Dataset(self.df.where(keep(F.col("value"))))

    def map_partitions_python(self, of: Callable[[Iterator[str]], Iterator[str]], batch: int = 10_000) -> "Dataset":
        """of sees each partition as one iterator, streamed batch by batch."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[str] = []
            for value in of(v for f in frames for v in f["value"]):
                held.append(value)
                if len(held) >= batch:
                    yield pd.DataFrame({"value": held})
                    held = []
            yield pd.DataFrame({"value": pd.Series(held, dtype=object)})

        return Dataset(self.df.mapInPandas(run, "value string"))

    def flat_map_python(self, of: Callable[[str], Iterable[str]]) -> "Dataset":
        return self.map_partitions_python(lambda values: (x for v in values for x in of(v) or ()))

    def sample(self, fraction: float, seed: int | None = None) -> "Dataset":
        return Dataset(self.df.sample(False, fraction, seed))

    def distinct(self) -> "Dataset":
        return Dataset(self.df.distinct())

    def intersection(self, other: "Dataset") -> "Dataset":
        return Dataset(self.df.intersect(other.df))

    def group_by(self, key: Callable[[Column], Column]) -> "PairDataset":
        """(key, comma-joined elements in order); ``grouped`` keeps arrays."""
        rows = self.grouped(key)
        return PairDataset(rows.select("key", F.array_join("values", ",").alias("value")))

    def grouped(self, key: Callable[[Column], Column]) -> DataFrame:
        return self.df.groupBy(key(F.col("value")).alias("key")).agg(F.array_sort(F.collect_list("value")).alias("values"))

    def fold(self, zero: Column, step: Callable[[Column, Column], Column]) -> str:
        """step over all elements from zero. step must be associative and commutative with zero neutral: runs of
        FOLDED elements are folded where they are, then the runs' values, until one is left. No task holds more."""
        parts, left = self.df.select("value"), None
        while True:
            run = F.shiftright(F.col("at"), FOLDED.bit_length() - 1)  # rows of a partition have consecutive numbers
            folded = parts.withColumn("at", F.monotonically_increasing_id()).groupBy(run.alias("run")).agg(F.collect_list("value").alias("v"))
            parts = checkpointed(folded.select(F.aggregate("v", zero, step).alias("value")))
            before, left = left, parts.count()
            if left == 1:
                return parts.first()["value"]
            if left == 0:
                return self.df.sparkSession.range(1).select(zero).first()[0]
            if before is not None or left <= FOLDED:
                parts = parts.coalesce(max(1, left // FOLDED))

    def fold_sum(self) -> float:
        return self.df.agg(F.sum(F.col("value").cast("double"))).first()[0]


class PairDataset(_Held):
    """A bag of pairs: key, value; not grouped."""

    @classmethod
    def parallelize(cls, spark: SparkSession, pairs: Iterable[tuple[str, str]]) -> "PairDataset":
        return cls(spark.createDataFrame(list(pairs), "key string, value string"))

    def collect(self) -> list[tuple[str, str]]:
        return [(r["key"], r["value"]) for r in self.df.collect()]

    def sorted(self) -> DataFrame:
        return self.df.orderBy("key", "value")

    def save_as_table(self, store, name: str) -> DataFrame:
        """One row per key with its values as an array."""
        return store.save(name, self.df.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias("value")))

    def flat_map(self, of: Callable[[Column, Column], Column]) -> Dataset:
        return Dataset(self.df.select(F.explode(of(F.col("key"), F.col("value")).cast("array<string>")).alias("value")).where("value is not null"))

    def flat_map_to_pair(self, of: Callable[[Column, Column], Column]) -> "PairDataset":
        return PairDataset(self.df.select(F.explode(of(F.col("key"), F.col("value"))).alias("p")).select("p.key", "p.value"))

    def fold_by_key(self, zero: Column, step: Callable[[Column, Column], Column]) -> "PairDataset":
        """step over each key's values in sorted order; for sums and the like use ``aggregate_by_key``."""
        return PairDataset(self.df.groupBy("key").agg(F.aggregate(F.array_sort(F.collect_list("value")), zero, step).alias("value")))

    def aggregate_by_key(self, of: Callable[[Column], Column]) -> "PairDataset":
        """A built-in aggregate of each key's values, partly done before the shuffle."""
        return PairDataset(self.df.groupBy("key").agg(of(F.col("value")).alias("value")))

    def join(self, other: "PairDataset") -> "PairDataset":
        """Per key every value of the left with every value of the right, as left,right."""
        both = self.df.alias("a").join(other.df.alias("b"), "key")
        return PairDataset(both.select("key", F.concat_ws(",", "a.value", "b.value").alias("value")))

    def cogroup_arrays(self, other: "PairDataset") -> DataFrame:
        """key, left, right: all values of either side, empty where a side has none."""
        sides = [d.df.groupBy("key").agg(F.array_sort(F.collect_list("value")).alias(n)) for d, n in ((self, "left"), (other, "right"))]
        empty = F.array().cast("array<string>")
        return sides[0].join(sides[1], "key", "full").select("key", F.coalesce("left", empty).alias("left"), F.coalesce("right", empty).alias("right"))

    def cogroup(self, other: "PairDataset") -> "PairDataset":
        """The same as text: [x1,x2],[y1]."""
        text = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
        return PairDataset(self.cogroup_arrays(other).select("key", F.concat_ws(",", text("left"), text("right")).alias("value")))

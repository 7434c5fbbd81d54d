"""Wide-row tables: a string key and columns that appear when written.

Names that begin with "pt-" are kept as Parquet under a root folder, others as temporary views. All
operations are DataFrames: an upsert is a union with the latest row per key winning, a row replacement
an anti join and a union, a range scan a filter that reaches the Parquet footers. Batch forms take a
DataFrame of changes, since a lake table is rewritten by files and not by cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PERSISTENT = "pt-"
PAGE_ROWS = 10
#: Endings of a table on its way in and out.
NEW, OLD = "~", "~~"


def upsert(base: DataFrame, delta: DataFrame, key: str = "key", version: str | None = None) -> DataFrame:
    """Per key and column the last value that is not null; delta wins over base, later versions over earlier."""
    order = "_order"
    both = base.withColumn(order, F.struct(F.lit(0).alias("side"), (F.col(version) if version in base.columns else F.lit(None)).cast("string").alias("v")))
    both = both.unionByName(
        delta.withColumn(order, F.struct(F.lit(1).alias("side"), (F.col(version) if version in delta.columns else F.lit(None)).cast("string").alias("v"))),
        allowMissingColumns=True,
    )
    kept = [c for c in both.columns if c not in (key, order)]
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in kept]
    return both.groupBy(key).agg(*latest) if kept else both.select(key).distinct()


def latest_rows(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key."""
    window = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def replace_rows(base: DataFrame, delta: DataFrame, key: str = "key") -> DataFrame:
    """Whole rows of delta in place of base's rows with the same key."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta, allowMissingColumns=True)


def conditional_put(base: DataFrame, column: str, new: Column, if_column: str, equals) -> DataFrame:
    """column becomes new in the rows where if_column equals the value; others stay."""
    return base.withColumn(column, F.when(F.col(if_column).eqNullSafe(F.lit(equals)), new).otherwise(F.col(column)))


def scan(table: DataFrame, start: str | None = None, stop: str | None = None, key: str = "key") -> DataFrame:
    """Rows with start <= key < stop in key order; either end may be open."""
    if start is not None:
        table = table.where(F.col(key) >= start)
    if stop is not None:
        table = table.where(F.col(key) < stop)
    return table.orderBy(key)


def page(table: DataFrame, number: int, rows: int = PAGE_ROWS, key: str = "key") -> DataFrame:
    """Page `number` (from 1) in key order."""
    return table.orderBy(key).offset(rows * (max(1, number) - 1)).limit(rows)


class TableStore:
    """A catalog of wide-row tables under one root folder (any store Spark can write)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._views: dict[str, DataFrame] = {}

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        if not name.startswith(PERSISTENT):
            return name in self._views
        files = self._files()
        if not files.exists(self._path(name)) and files.exists(self._path(name + OLD)):
            files.rename(self._path(name + OLD), self._path(name))  # a driver was lost while it replaced the table
        return files.exists(self._path(name))

    def names(self) -> list[str]:
        files = self._files()
        root = self._path("")
        kept = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
        return sorted([*self._views, *[n for n in kept if n.startswith(PERSISTENT) and not n.endswith("~")]])

    def read(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{name}") if name.startswith(PERSISTENT) else self._views[name]

    def save(self, name: str, rows: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
        """Write or replace a table, with the writer's options; a table may be computed from its own former rows."""
        if not name.startswith(PERSISTENT):
            self._views[name] = rows
            return rows
        rows.write.mode("overwrite").options(**(options or {})).parquet(f"{self.root}/{name}{NEW}")
        files = self._files()
        files.delete(self._path(name + OLD), True)
        if files.exists(self._path(name)):  # the old table is there until the new one has its name
            files.rename(self._path(name), self._path(name + OLD))
        files.rename(self._path(name + NEW), self._path(name))
        files.delete(self._path(name + OLD), True)
        return self.read(name)

    def put(self, name: str, delta: DataFrame, key: str = "key") -> DataFrame:
        return self.save(name, upsert(self.read(name), delta, key) if self.exists(name) else delta)

    def put_rows(self, name: str, delta: DataFrame, key: str = "key") -> DataFrame:
        return self.save(name, replace_rows(self.read(name), delta, key) if self.exists(name) else delta)

    def get_row(self, name: str, row: str, key: str = "key") -> DataFrame:
        return self.read(name).where(F.col(key) == row)

    def get(self, name: str, row: str, column: str, key: str = "key"):
        """The cell's value, None where there is none."""
        table = self.read(name)
        if column not in table.columns:
            return None
        found = table.where(F.col(key) == row).select(column).first()
        return None if found is None else found[0]

    def exists_row(self, name: str, row: str, key: str = "key") -> bool:
        return not self.get_row(name, row, key).isEmpty()

    def exists_rows(self, name: str, keys: DataFrame, key: str = "key") -> DataFrame:
        """Those of the keys (a column of the same name) that the table has."""
        return keys.select(key).join(self.read(name), key, "left_semi")

    def count(self, name: str) -> int:
        return self.read(name).count() if self.exists(name) else 0

    def rename(self, old: str, new: str) -> None:
        """Raises KeyError for an unknown table, ValueError where the new name is taken or of the other kind."""
        if not self.exists(old):
            raise KeyError(old)
        if self.exists(new) or old.startswith(PERSISTENT) != new.startswith(PERSISTENT):
            raise ValueError(new)
        if old.startswith(PERSISTENT):
            self._files().rename(self._path(old), self._path(new))
        else:
            self._views[new] = self._views.pop(old)

    def delete(self, name: str) -> bool:
        """Whether there was such a table."""
        if not self.exists(name):
            return False
        if name.startswith(PERSISTENT):
            self._files().delete(self._path(name), True)
        else:
            del self._views[name]
        return True

"""What a job is given: tables, output, sources and the degree of parallelism."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, SparkSession

from textloom.operators.dataset import Dataset
from textloom.sources.tables import TableStore


class Context:
    """Passed to a job's function; ``run`` gives back what the job put out."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.store, self._out = spark, TableStore(spark, root), []

    def output(self, text: str) -> None:
        self._out.append(text)

    def parallelize(self, values: Iterable[str]) -> Dataset:
        return Dataset.parallelize(self.spark, values)

    def from_table(self, name: str, of: Column) -> Dataset:
        return Dataset.from_table(self.store.read(name), of)

    def set_concurrency_level(self, tasks: int) -> None:
        """Tasks per shuffle from now on."""
        self.spark.conf.set("spark.sql.shuffle.partitions", tasks)

    @classmethod
    def run(cls, spark: SparkSession, root: str, job: Callable[["Context", list[str]], None], arguments: list[str]) -> str:
        """A failing job raises; there is no partial success."""
        context = cls(spark, root)
        job(context, arguments)
        return "".join(context._out) or "Job finished, but produced no output"

"""Row wire format, line files and JSON results."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_row(key: str, cells: dict[str, bytes]) -> bytes:
    """``key SP (column SP length SP bytes SP)*``; neither key nor column may hold a space or newline."""
    if any(c in name for name in (key, *cells) for c in " \n"):
        raise ValueError("a key or column name holds a space or a newline")
    return b"".join([key.encode() + b" ", *[f"{name} {len(value)} ".encode() + value + b" " for name, value in cells.items()]])


def read_rows(data: bytes) -> Iterator[tuple[str, dict[str, bytes]]]:
    """Rows of a stream: each ends with a newline, an empty line or the end of data ends the stream."""
    at = 0

    def word() -> str:
        nonlocal at
        stop = data.index(b" ", at)
        out, at = data[at:stop].decode(), stop + 1
        return out

    while at < len(data) and data[at : at + 1] != b"\n":
        key, cells = word(), {}
        while at < len(data) and data[at : at + 1] != b"\n":
            name, size = word(), int(word())
            cells[name] = data[at : at + size]
            at += size + 1
        at += 1
        yield key, cells


def wide_rows(binary: DataFrame, column: str = "content") -> DataFrame:
    """Rows (key, cells) of binary files in the wire format, e.g. from spark.read.format("binaryFile")."""
    import pyarrow as pa

    def parse(batches):
        for batch in batches:
            rows = [r for data in batch.column(column).to_pylist() for r in read_rows(data or b"")]
            cells = pa.array([list(c.items()) for _, c in rows], pa.map_(pa.string(), pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), cells], names=["key", "cells"])

    return binary.select(column).mapInArrow(parse, "key string, cells map<string,binary>")


def wire_rows(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """content: the rows of each batch in the wire format, the named columns as cells; null cells are left out."""
    import pyarrow as pa

    def write(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                cells = {c: row[c].encode() for c in columns if row[c] is not None}
                out.append(write_row(row[key], cells) + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["content"])

    return rows.select(key, *columns).mapInArrow(write, "content binary")


def line_set(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines of a text file as term."""
    return spark.read.text(path).select(F.col("value").alias("term")).distinct()


def results_json(results: DataFrame, *columns: str) -> DataFrame:
    """One JSON array per result page of the given columns, in the order of their `rank` column."""
    row = F.struct("rank", *columns)
    ordered = F.transform(F.sort_array(F.collect_list(row)), lambda r: F.struct(*[r[c].alias(c) for c in columns]))
    return results.agg(F.to_json(ordered).alias("json"))

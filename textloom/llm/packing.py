"""Best-fit packing planned on the length histogram.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. Only the histogram of piece
lengths (at most ``capacity`` counts) reaches the driver, which packs counts, not pieces: lengths go in
falling order, each into the fullest kind of sequence that still holds it. Every placement covers an
interval of ranks within its length; pieces then take their slots by joining on (length, rank). Pieces of
full length need no rank: each is a sequence of its own (those have negative numbers).

The plan's size depends on the capacity alone: each length touches the kinds of sequence that exist,
splits at most one of them and opens at most two, so there are fewer than capacity squared intervals.

Defined cases: a null text is empty and gives the end token alone; an empty table gives no rows;
repeated rows are packed as often as they occur. Pieces of one length are ranked by their places in the
table of pieces, so equal rows are as easy to deal out as any others.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import crc_u32, cut, slices
from textloom.llm.encoder import BATCH_BYTES, task_encoder

CAPACITY = 1024
END_ID = 2
#: Rows ranked by one window group; longer runs of one length are split into more groups.
RANKED_ROWS = 512

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but perhaps the first."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *[(s, capacity) for s in range(first, n, capacity)]]


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32 bit) of every piece."""

    def cut_up(batches):
        tail = np.array([end_id], dtype="<u4")
        with task_encoder(path) as enc:
            for batch in batches:
                for part in slices(batch, limit=BATCH_BYTES):
                    cols = [[], [], [], [], [], []]
                    flat, bounds = enc.encode_flat(part.column("text"))
                    for doc_id, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                        ids = np.append(flat[a:b], tail)
                        for k, (start, length) in enumerate(cut_points(len(ids), capacity)):
                            own = ids[start : start + length]
                            for col, x in zip(cols, (doc_id, k, start, length, crc_u32(own), own.tobytes() if keep_ids else None)):
                                col.append(x)
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                    n = 6 if keep_ids else 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:n], types)], names=names[:n])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut_up, PIECES + (", ids binary" if keep_ids else ""))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, ...]], int]:
    """Best-fit-decreasing over counts.

    Returns intervals (length, first rank, pieces per sequence, first sequence, offset) sorted by length
    and rank, and the number of sequences. Sequences of one kind (same filling so far) are a run of ids.
    """
    free: list[int] = []  # room left, ascending, where kinds exist
    kinds: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, count)
    out, used = [], 0

    def put(room: int, first: int, count: int) -> None:
        if count and room:
            if room not in kinds:
                kinds[room] = []
                bisect.insort(free, room)
            kinds[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect.bisect_left(free, length)
            if k < len(free):  # the fullest kind that still has room
                room = free[k]
                first, count = kinds[room].pop()
                if not kinds[room]:
                    del kinds[room], free[k]
            else:  # new sequences
                room, first, count = capacity, used, -(-left // (capacity // length))
                used += count
            each = room // length
            full = min(count, left // each)
            if full:
                out.append((length, rank, each, first, capacity - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            if full < count:
                if left:  # the last pieces of this length fill a part of one more sequence
                    out.append((length, rank, left, first + full, capacity - room))
                    put(room - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                put(room, first + full, count - full)
    return sorted(out), used


def ranked(rows: DataFrame, histogram: dict[int, int], mark: str, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Add rank, gapless from 0 within each length, without one task holding a whole length; mark is unique."""
    spark = rows.sparkSession
    groups = spark.createDataFrame([(k, max(1, -(-n // ranked_rows))) for k, n in histogram.items()] or [(0, 1)], "length long, _groups long")
    # at most `capacity` rows: the broadcast has a fixed bound
    dealt = rows.join(F.broadcast(groups), "length").withColumn("_group", F.pmod(F.xxhash64(mark), F.col("_groups"))).drop("_groups")
    key = ["length", "_group"]
    within = Window.partitionBy(*key).orderBy(mark)
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return dealt.withColumn("_at", F.row_number().over(within)).join(bases, key).withColumn("rank", F.col("_base") + F.col("_at") - 1).drop("_group", "_at", "_base")


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    every = cut(pieces(docs, capacity, end_id, path).withColumn("mark", F.monotonically_increasing_id()), "pieces")
    own = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = every.where(F.col("length") == capacity).select(*own, (-F.col("mark") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows = every.where(F.col("length") < capacity)
    histogram = {int(r["length"]): int(r["count"]) for r in rows.groupBy("length").count().collect()}
    intervals, _ = plan(histogram, capacity)
    lengths, firsts, eachs, seqs, offsets = (np.array(c, dtype=np.int64) for c in (zip(*intervals) if intervals else [()] * 5))
    spans = {int(n): (int(np.searchsorted(lengths, n)), int(np.searchsorted(lengths, n, "right"))) for n in np.unique(lengths)}

    def slots(batches):
        for batch in batches:
            n, r = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.zeros(len(n), dtype=np.int64)
            for length in np.unique(n):
                a, b = spans[int(length)]
                same = n == length
                at[same] = a + np.searchsorted(firsts[a:b], r[same], "right") - 1
            inside = r - firsts[at]
            found = [seqs[at] + inside // eachs[at], offsets[at] + inside % eachs[at] * n] if len(n) else [n, n]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *map(pa.array, found)], names=[*own, "sequence_id", "offset"])

    placed = ranked(rows, histogram, "mark").select(*own, "rank").mapInArrow(slots, PIECES + ", sequence_id long, offset long")
    return full.unionByName(placed)

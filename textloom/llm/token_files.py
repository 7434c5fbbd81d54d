"""Token-id files: one concatenated id array per file, document boundaries in Elias-Fano form.

A file is a byte string: magic, counts, the Elias-Fano ends of the documents, the Elias-Fano doc_ids,
then the ids in 2 bytes each where the vocabulary allows, else 4. A monotone list of n numbers below u
takes about 2 + log2(u/n) bits per number: the low bits are packed, the high bits are a unary bit
vector, and a sample of every SAMPLE-th one-bit's position answers select without a table of offsets.

Files go out as rows of a Parquet table, in ascending doc_id order: any store Spark writes to will do.
``write_files`` puts the table where it is told, or into the shared folder until the driver ends; ``export``
writes each file under a name of its own into a folder that all executors see.

Defined cases: a null text is empty and gives the end id alone; null doc_ids come last; equal doc_ids
keep every row, ordered by a hash of the text; an empty table gives no files.
"""

from __future__ import annotations

import os
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import crc_u32, cut, input_bytes, partitions_for, slices
from textloom.llm.encoder import BATCH_BYTES, task_encoder

MAGIC = b"TLEF1\0"
HEAD = struct.Struct("<6sBxQQQ")
LIST = struct.Struct("<qQBxxxxxxx")
SAMPLE = 256
END_ID = 0
#: Ids per file: 8 MB in two bytes each.
FILE_IDS = 4 << 20

FILES = "part int, seq int, n_docs long, n_ids long, file binary"


def ef_pack(values: np.ndarray) -> bytes:
    """Elias-Fano form of ascending integers."""
    n = len(values)
    base = int(values[0]) if n else 0
    rest = (values.astype(np.int64) - base).astype(np.uint64)
    top = int(rest[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    high = (rest >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(high[-1]) + 1 if n else 0, dtype=np.uint8)
    bits[high] = 1
    lows = ((rest[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() if low else np.zeros(0, np.uint8)
    parts = [np.packbits(lows, bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), high[::SAMPLE].astype("<u4").tobytes()]
    return LIST.pack(base, n, low) + struct.pack("<QQQ", *map(len, parts)) + b"".join(parts)


class EliasFano:
    """Reader of one packed list; ``stop`` is where it ends in the buffer."""

    def __init__(self, buffer, start: int = 0) -> None:
        self.base, self.n, self.low = LIST.unpack_from(buffer, start)
        sizes = struct.unpack_from("<QQQ", buffer, start + LIST.size)
        at = start + LIST.size + 24
        self.lows, self.bits, self.samples = (np.frombuffer(buffer, np.uint8, s, at + sum(sizes[:k])) for k, s in enumerate(sizes))
        self.samples = self.samples.view("<u4")
        self.stop = at + sum(sizes)

    def _low(self, k: int) -> int:
        first, last = k * self.low, (k + 1) * self.low
        word = int.from_bytes(self.lows[first // 8 : (last + 7) // 8].tobytes(), "little")
        return word >> first % 8 & (1 << self.low) - 1

    def select(self, k: int) -> int:
        """The k-th number, from the sample before it and at most SAMPLE further one-bits."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at = int(self.samples[k // SAMPLE])
        need, byte = k % SAMPLE, at // 8
        word = int(self.bits[byte]) >> at % 8 << at % 8
        while (ones := word.bit_count()) <= need:
            need, byte = need - ones, byte + 1
            word = int(self.bits[byte])
        for _ in range(need):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - k
        return self.base + (high << self.low | (self._low(k) if self.low else 0))

    def all(self) -> np.ndarray:
        high = np.flatnonzero(np.unpackbits(self.bits, bitorder="little")) - np.arange(self.n)
        out = high.astype(np.int64) << self.low
        if self.low:
            bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
            out |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low, dtype=np.int64))
        return out + self.base


def file_bytes(doc_ids: list, ids: list[np.ndarray], width: int = 2) -> bytes:
    """One file; doc_ids ascend with nulls last."""
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
    data = (np.concatenate(ids) if ids else np.zeros(0)).astype(f"<u{width}").tobytes()
    return HEAD.pack(MAGIC, width, len(ids), int(ends[-1]) if len(ids) else 0, len(known)) + ef_pack(ends) + ef_pack(known) + data


class TokenFile:
    """Reader of one file: document k's ids are ids(k); their place comes from select."""

    def __init__(self, data: bytes) -> None:
        magic, self.width, self.n_docs, self.n_ids, self.n_known = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ends = EliasFano(data, HEAD.size)
        self.keys = EliasFano(data, self.ends.stop)
        self.data = np.frombuffer(data, f"<u{self.width}", self.n_ids, self.keys.stop)

    def doc_ids(self) -> list:
        return [*self.keys.all().tolist(), *[None] * (self.n_docs - self.n_known)]

    def ids(self, k: int) -> np.ndarray:
        return self.data[self.ends.select(k - 1) if k else 0 : self.ends.select(k)]


def write_files(docs: DataFrame, end_id: int = END_ID, path: str | None = None, file_ids: int = FILE_IDS, to: str | None = None) -> DataFrame:
    """Encode every whole text and write files in ascending doc_id order, as a Parquet table at `to` if given;
    path is the vocabulary's. Returns the table of files."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    dealt = rows.repartitionByRange(partitions_for(spark, 2 * input_bytes(docs)), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def encode(batches):
        tail, part, width = np.array([end_id], dtype="<u4"), TaskContext.get().partitionId(), 2
        keys, ids, held, seq = [], [], 0, 0

        def flush():
            columns = [[part], [seq], [len(keys)], [held], [file_bytes(keys, ids, width)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "seq", "n_docs", "n_ids", "file"])

        with task_encoder(path) as enc:
            width = 2 if max(enc.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
            for batch in batches:
                for piece in slices(batch, limit=BATCH_BYTES):
                    flat, bounds = enc.encode_flat(piece.column("text"))
                    for key, a, b in zip(piece.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                        keys.append(key)
                        ids.append(np.append(flat[a:b], tail))
                        held += b - a + 1
                        if held >= file_ids:
                            yield flush()
                            keys, ids, held, seq = [], [], 0, seq + 1
            if keys:
                yield flush()

    files = dealt.mapInArrow(encode, FILES)
    if to is None:
        return cut(files, "token-files")
    files.write.parquet(to)
    return spark.read.schema(FILES).parquet(to)


def file_name(part: int, seq: int) -> str:
    """Names sort as the files do."""
    return f"tokens-{part:06d}-{seq:06d}.tlef"


def export(files: DataFrame, folder: str) -> DataFrame:
    """Write each file under its own name into a folder that all executors see; name and bytes of each.

    A file is written beside its name and then renamed, so a task that runs again, or twice, does no harm.
    """

    def put(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names, sizes = [], []
            for part, seq, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "file"))):
                names.append(file_name(part, seq))
                sizes.append(len(data))
                fresh = os.path.join(folder, f".{names[-1]}.{uuid.uuid4().hex}")
                with open(fresh, "wb") as out:
                    out.write(data)
                os.replace(fresh, os.path.join(folder, names[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "bytes"])

    return cut(files.select("part", "seq", "file").mapInArrow(put, "name string, bytes long"), "exported")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def decode(batches):
        for batch in batches:
            for part, seq, data in zip(*(batch.column(c) for c in ("part", "seq", "file"))):
                file = TokenFile(data.as_py())
                n = file.n_docs
                ends = np.fromiter(map(file.ends.select, range(n)), dtype=np.int64, count=n)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crcs = [crc_u32(file.data[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), pa.array(file.doc_ids(), pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    rows = files.select("part", "seq", "file").mapInArrow(decode, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # ids before each part, then before each file of a part: a row per part, about one per 64 MB
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("part", "seq", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("seq_base")).join(parts, "part")
    return rows.join(bases, ["part", "seq"]).select("doc_id", (F.col("local") + F.col("part_base") + F.col("seq_base")).alias("start"), "n_tokens", "ids_crc32")

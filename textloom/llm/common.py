"""Small helpers that the corpus operators share: table access, cutting lineage, Arrow batches."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a worker takes at a time. Array code needs some thirty times this while it works.
BATCH_BYTES = 2 << 20
#: Bytes of an Arrow batch on its way between the JVM and Python.
ARROW_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes: texts may be long, and a batch is held by the JVM and by Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one table, read by Spark so that any store works."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder does for a
    local master, whose executors are the driver; on a cluster it is an error, as they don't share one."""
    bound_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, so that no later stage repeats
    the work above it and a lost executor costs nothing. The folder is removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept_until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def kept_until_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder when the driver ends."""
    atexit.register(_remove, spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone when the interpreter ends
        pass


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files below df; sources whose size is unknown count as nothing. For partition counts."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return sum(s for s in sizes if s < 1 << 60)


def partitions_for(spark: SparkSession, n_bytes: int, each: int = 64 << 20) -> int:
    """At least the session's shuffle partitions, more as the data grow."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // each))


#: A key with over this share of all rows is hot: there are fewer such keys than one over the share.
HOT_SHARE = 0.001


def join_by_weight(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of left with right, which has one row per key and in `weight` how many rows of left have it;
    total is at least the sum of weights. The hot keys, at most a thousand, are broadcast, so their rows stay where
    they are; only the others are dealt by key. Both sides are read more than once: give written tables."""
    hot = F.col(weight) > HOT_SHARE * total
    few = F.broadcast(right.where(hot).drop(weight))
    rest = left.join(few.select(*keys), keys, "left_anti")
    return left.join(few, keys).unionByName(rest.join(right.where(~hot).drop(weight), keys))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES):
    """Cut an Arrow batch into row ranges of about `limit` bytes, so that long texts don't pile up."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(lengths) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(edges[:-1], edges[1:]):
        yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def crc_u32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; TEXTLOOM_TOKENIZERS overrides the folder."""
    folder = os.environ.get("TEXTLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


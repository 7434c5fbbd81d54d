"""Sharding by a two-pass external shuffle of whole records, DataFrame functions only.

Pass one scatters the records uniformly into buckets that fit in memory, by seeded hashes. Pass two
shuffles each bucket by Fisher and Yates and writes it behind the buckets before it. The swaps are drawn
from a hash of (seed, shard, bucket, step), so a bucket's order follows from its records and the seed
alone, whatever the number of partitions, and a task that is run again writes the same.

The shard of a row follows the ``key`` law by highest-random-weight hashing: doc_id and the number of
shards decide, and a further shard takes rows only into itself.

Rows that are equal in all columns are counted first, and drawn again from one of them by number, so that
each copy has a bucket of its own: no bucket grows with the copies of one row.

Defined cases: a null doc_id is one more key; a null text has size 1; rows with equal doc_id share a shard
and are spread over its buckets; equal rows are kept as often as they occur; an empty table writes no rows;
columns of the input that have the names of ours make ours longer; further columns are ignored by
``assign`` and carried by ``write_shards``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, input_bytes, kept_until_exit, partitions_for, shared_folder, unused

SHARDS = 16
SEED = 20_231
#: Most records and bytes of a bucket, on average. A swap costs as much as a bucket has records.
BUCKET_ROWS, BUCKET_BYTES = 512, 4 << 20
#: Copies of one row that are drawn in one go.
COPIES = 4096


def _weights(key: str, shards: int, seed: int) -> list:
    return [F.struct(F.xxhash64(F.lit(seed), F.lit(k), F.col(key)).alias("w"), F.lit(k).alias("k")) for k in range(shards)]


def shard_of(key: str, shards: int, seed: int) -> F.Column:
    return F.array_max(F.array(*_weights(key, shards, seed)))["k"]


def grown_shard_of(key: str, shards: int, seed: int) -> F.Column:
    """The shard with one more of them."""
    return shard_of(key, shards + 1, seed)


def permutation(n: F.Column, *key: F.Column) -> F.Column:
    """A permutation of 0 .. n - 1 by Fisher and Yates, its swaps drawn from a hash of key and step."""
    steps = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: i < n)
    drawn = F.transform(steps, lambda i: F.pmod(F.xxhash64(*key, i), i + 1).cast("int"))

    def swapped(held: F.Column, at: F.Column) -> F.Column:
        """The next number takes the place drawn for it, what stood there goes to the end."""
        size = F.size(held)
        inner = F.concat(F.slice(held, F.lit(1), at), F.array(size), F.slice(held, at + 2, size - at - 1), F.array(F.get(held, at)))
        return F.when(at == size, F.concat(held, F.array(size))).otherwise(inner)

    return F.aggregate(drawn, F.array(F.lit(0)), swapped)


def _row_hash(docs: DataFrame) -> F.Column:
    """64 bits over all columns; maps, which have no hash, by their JSON."""
    return F.xxhash64(*[F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields])


def _drawn_again(rows: DataFrame, n: str, copy: str, *key: str) -> DataFrame:
    """Each row n times, numbered from 0 as copy; the copies of one row are made in many tasks."""
    last = F.ceil(F.col(n) / COPIES).cast("int") - 1
    parts = rows.withColumn(copy, F.explode(F.sequence(F.lit(0), last)))
    first = F.col(copy) * COPIES
    return parts.repartition(*key, copy).withColumn(copy, F.explode(F.sequence(first, F.least(first + COPIES, F.col(n).cast("int")) - 1)))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> tuple[str, str]:
    """Write the records with all their columns as Parquet under path, a folder per shard, in shuffled order.

    Returns the names of the columns that hold shard and slot (from 0 in each shard, without gaps).
    """
    spark = docs.sparkSession
    shard, slot, row, copy, bucket, n, base, order, at = (unused(docs, x) for x in ("shard", "slot", "row", "copy", "bucket", "n", "base", "order", "at"))
    place = [shard, bucket]
    known = docs.withColumn(row, _row_hash(docs)).withColumn(shard, shard_of("doc_id", shards, seed))
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + F.lit(1)
    digests = cut(known.select(row, shard, size.cast("long").alias(n)), "shard-digests")
    rows, size = digests.agg(F.count(F.lit(1)), F.coalesce(F.sum(n), F.lit(0))).first()
    buckets = max(1, -(-rows // (shards * bucket_rows)), -(-size // (shards * bucket_bytes)))
    in_bucket = F.pmod(F.xxhash64(F.lit(seed + 1), row, copy), F.lit(buckets)).cast("int")

    counts = digests.groupBy(row, shard).agg(F.count(F.lit(1)).alias(n))
    repeated = cut(counts.where(F.col(n) > 1), "repeated-rows")
    # how many rows fall into each bucket: the first of each row, and its further copies where it has any
    numbers = counts.select(row, shard, F.lit(0).alias(copy))
    if several := not repeated.isEmpty():
        numbers = numbers.unionByName(_drawn_again(repeated, n, copy, row).where(F.col(copy) > 0).select(row, shard, copy))
    counts = numbers.groupBy(shard, in_bucket.alias(bucket)).agg(F.count(F.lit(1)).cast("int").alias(n))
    before = Window.partitionBy(shard).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    drawn = permutation(F.col(n), F.lit(seed + 2), F.col(shard), F.col(bucket))
    plan = counts.select(*place, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base), drawn.alias(order))
    plan = cut(plan, "bucket-orders")  # four bytes a record

    single = known.withColumn(copy, F.lit(0))
    if several:
        copies = known.join(repeated.select(row, n), row)  # Spark broadcasts by the size of the table, else sorts
        one = copies.groupBy(row).agg(F.max(n).alias(n), F.first(F.struct(*[f"`{c}`" for c in docs.columns], shard)).alias(at))
        again = _drawn_again(one, n, copy, row).select(*[F.col(at)[c].alias(c) for c in docs.columns], row, F.col(at)[shard].alias(shard), copy)
        single = single.join(repeated.select(row), row, "left_anti").select(*known.columns, copy).unionByName(again)
    scattered = single.withColumn(bucket, in_bucket).repartition(partitions_for(spark, max(2 * input_bytes(docs), size)), *place)
    numbered = scattered.withColumn(at, F.row_number().over(Window.partitionBy(*place).orderBy("doc_id", row, copy)) - 1)
    slots = numbered.join(plan, place).withColumn(slot, (F.col(base) + F.get(order, F.col(at))).cast("long"))
    slots.select(*[f"`{c}`" for c in docs.columns], slot, shard).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return shard, slot


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, read back from the shards
    that were written into the shared folder."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    shard, slot = write_shards(docs, path, shards, seed, bucket_rows, bucket_bytes)
    kept_until_exit(spark, path)
    written = spark.read.schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, {slot} long, {shard} int").parquet(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    return written.select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"), F.col(shard).alias("shard"), F.col(slot).alias("slot"), grown_shard_of("doc_id", shards, seed).alias("grown_shard"),
    )

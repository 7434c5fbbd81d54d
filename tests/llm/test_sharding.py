import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import sharding

from .conftest import ODD

SEED = sharding.SEED


def spark_hash(*values):
    """xxhash64 of Spark over numbers (int as 4 bytes, long as 8) given as (value, bytes), seed 42, nulls skipped."""
    out = 42
    for value, size in values:
        if value is not None:
            out = xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=True), seed=out)
    return out - (1 << 64) if out >> 63 else out


def shuffled(n, shard, bucket):
    """Fisher and Yates with the operator's draws."""
    held = [0]
    for i in range(1, n):
        j = spark_hash((SEED + 2, 4), (shard, 4), (bucket, 4), (i, 4)) % (i + 1)
        held.append(i)
        held[i], held[j] = held[j], i
    return held


def expected(rows, shards=16, bucket_rows=512):
    """doc_id, shard, slot, grown shard from (doc_id, row hash), by plain Python."""
    buckets = max(1, -(-len(rows) // (shards * bucket_rows)))
    held, seen = defaultdict(list), defaultdict(int)
    for doc_id, row in rows:
        weights = [(spark_hash((SEED, 4), (k, 4), (doc_id, 8)), k) for k in range(shards + 1)]
        copy, seen[row] = seen[row], seen[row] + 1
        held[max(weights[:-1])[1], spark_hash((SEED + 1, 4), (row, 8), (copy, 4)) % buckets].append((doc_id, row, copy, max(weights)[1]))
    out, base = [], defaultdict(int)
    for shard, bucket in sorted(held):
        own = sorted(held[shard, bucket], key=lambda r: (r[0] is not None, r[0] or 0, *r[1:3]))
        for k, r in zip(shuffled(len(own), shard, bucket), own):
            out.append((r[0], shard, base[shard] + k, r[3]))
        base[shard] += len(own)
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_rows", [4, 512])
def test_against_brute_force(small, bucket_rows):
    docs, texts = small
    docs = docs.select("doc_id", "text")
    hashes = [tuple(r) for r in docs.select("doc_id", F.xxhash64("doc_id", "text")).collect()]
    rows = sharding.assign(docs, bucket_rows=bucket_rows).collect()
    assert sorted(((r["doc_id"], r["shard"], r["slot"], r["grown_shard"]) for r in rows), key=str) == expected(hashes, bucket_rows=bucket_rows)
    known = dict(texts)
    for r in rows:
        raw = known[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 16)


def test_copies_of_one_row(spark):
    """A third of all rows are one row: its copies are spread over the buckets, and come out as often as they went in."""
    rows = [(7, "the same")] * 500 + [(k, f"text {k}") for k in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = [tuple(r) for r in docs.select("doc_id", F.xxhash64("doc_id", "text")).collect()]
    found = sharding.assign(docs, bucket_rows=8).collect()
    assert sorted(((r["doc_id"], r["shard"], r["slot"], r["grown_shard"]) for r in found), key=str) == expected(hashes, bucket_rows=8)


def test_order_does_not_depend_on_partitions(spark, small):
    docs = small[0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in (4, 7, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, sharding.assign(docs.repartition(n), bucket_rows=4).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


def test_permutations(spark):
    rows = spark.range(1, 60).select(F.col("id").cast("int").alias("n")).withColumn("p", sharding.permutation(F.col("n"), F.lit(1), F.col("n")))
    assert all(sorted(r["p"]) == list(range(r["n"])) for r in rows.collect())
    many = spark.range(6000).select(sharding.permutation(F.lit(3), F.col("id")).alias("p")).groupBy("p").count().collect()
    assert len(many) == 6 and all(850 < r["count"] < 1150 for r in many)


def test_order_is_shuffled(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")
    order = [r["doc_id"] for r in sharding.assign(docs).where("shard = 3").orderBy("slot").collect()]
    rises = sum(a < b for a, b in zip(order, order[1:])) / len(order)
    assert 0.35 < rises < 0.65


def test_odd(odd, none):
    rows = sharding.assign(odd).collect()
    assert len(rows) == len(ODD) and {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert sharding.assign(none).count() == 0


def test_written_shards(spark, odd, tmp_path):
    docs = odd.withColumn("_shard", F.lit("own")).withColumn("_slot", F.lit(5))
    shard, slot = sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(docs.columns) | {shard, slot} == set(back.columns) and back.where("_shard = 'own' and _slot = 5").count() == len(ODD)
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    slots = defaultdict(list)
    for r in back.collect():
        slots[r[shard]].append(r[slot])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    for folder in (tmp_path / "out").glob("*=*"):  # files hold their slots in order
        for part in folder.glob("*.parquet"):
            own = [r[slot] for r in spark.read.parquet(str(part)).select(slot).collect()]
            assert own == sorted(own)


def test_no_python_in_the_plan(odd):
    plan = sharding.assign(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

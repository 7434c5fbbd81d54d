"""Wide-row tables, wire format, streaming upsert."""

import pytest
from pyspark.sql import functions as F

from textloom.sources import formats, tables
from textloom.streaming import running_word_count, upsert_into


@pytest.fixture
def store(spark, tmp_path):
    return tables.TableStore(spark, str(tmp_path))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_put_overwrites_cells(spark, store):
    store.put("pt-a", spark.createDataFrame([("k", "one"), ("l", "x")], "key string, a string"))
    store.put("pt-a", spark.createDataFrame([("k", "two", "b")], "key string, a string, b string"))
    assert rows(store.read("pt-a").select("key", "a", "b")) == [("k", "two", "b"), ("l", "x", None)]
    assert store.get("pt-a", "k", "a") == "two" and store.get("pt-a", "k", "zz") is None and store.get("pt-a", "none", "a") is None
    assert store.exists_row("pt-a", "l") and not store.exists_row("pt-a", "m")
    assert store.count("pt-a") == 2 and store.count("pt-none") == 0


def test_put_rows_replaces(spark, store):
    for name in ("pt-b", "b"):
        store.put_rows(name, spark.createDataFrame([("k", "1", "2")], "key string, a string, b string"))
        store.put_rows(name, spark.createDataFrame([("k", "3")], "key string, a string"))
        assert rows(store.read(name).select("key", "a", "b")) == [("k", "3", None)]


def test_rename_and_delete(spark, store):
    table = spark.createDataFrame([("k", "1")], "key string, a string")
    for old, new, other in (("pt-x", "pt-y", "z"), ("x", "y", "pt-z")):
        store.save(old, table)
        store.rename(old, new)
        assert not store.exists(old) and store.count(new) == 1
        with pytest.raises(KeyError):
            store.rename(old, new)
        with pytest.raises(ValueError):
            store.rename(new, other)
        store.save(old, table)
        with pytest.raises(ValueError):
            store.rename(old, new)
    assert store.names() == ["pt-x", "pt-y", "x", "y"]
    assert store.delete("pt-x") and not store.delete("pt-x") and store.delete("x")
    with pytest.raises(KeyError):
        store.read("pt-x")


def test_a_table_survives_a_driver_lost_while_saving(spark, store, tmp_path):
    table = spark.createDataFrame([("k", "1")], "key string, a string")
    store.save("pt-a", table)
    store.save("pt-a", store.read("pt-a").withColumn("a", F.lit("2")))
    assert store.get("pt-a", "k", "a") == "2" and [x.name for x in tmp_path.iterdir()] == ["pt-a"]
    (tmp_path / "pt-a").rename(tmp_path / "pt-a~~")  # lost between the two renamings
    assert store.exists("pt-a") and store.get("pt-a", "k", "a") == "2" and store.names() == ["pt-a"]


def test_scan_and_pages(spark):
    table = spark.createDataFrame([(f"k{n:02d}",) for n in range(25)], "key string")
    assert [r[0] for r in tables.scan(table, "k03", "k06").collect()] == ["k03", "k04", "k05"]
    assert [r[0] for r in tables.page(table, 3).collect()] == [f"k{n}" for n in range(20, 25)]


def test_conditional_put(spark):
    table = spark.createDataFrame([(1, "old"), (2, "other")], "id int, v string")
    assert rows(tables.conditional_put(table, "v", F.lit("new"), "v", "old")) == [(1, "new"), (2, "other")]


def test_wire_format(spark, tmp_path):
    data = formats.write_row("k1", {"a": b"x y\nz", "b": b""}) + b"\n" + formats.write_row("k2", {}) + b"\n\n"
    assert list(formats.read_rows(data)) == [("k1", {"a": b"x y\nz", "b": b""}), ("k2", {})]
    (tmp_path / "f").write_bytes(data)
    found = formats.wide_rows(spark.read.format("binaryFile").load(str(tmp_path / "f"))).collect()
    assert [(r["key"], {k: bytes(v) for k, v in r["cells"].items()}) for r in found] == [("k1", {"a": b"x y\nz", "b": b""}), ("k2", {})]
    with pytest.raises(ValueError):
        formats.write_row("k 1", {})


def test_line_set(spark, tmp_path):
    (tmp_path / "words").write_text("a\nb\na\n")
    assert rows(formats.line_set(spark, str(tmp_path / "words"))) == [("a",), ("b",)]


def test_streaming(spark, store, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("k", "1"), ("l", "2")], "key string, a string").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("key string, a string").parquet(str(source))
    stream.writeStream.foreachBatch(upsert_into(store, "pt-s")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert rows(store.read("pt-s")) == [("k", "1"), ("l", "2")]
    lines = spark.createDataFrame([("A b a",)], "value string")
    assert rows(running_word_count(lines)) == [("a", 2), ("b", 1)]

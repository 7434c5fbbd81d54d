"""Dataflow goldens."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.operators import dataset
from textloom.operators.dataset import Dataset, Destroyed, PairDataset

LINES = ["red", "red blue", "green", "blue blue blue", "red", "green red", "violet", "green"]


def test_collect_keeps_duplicates(spark):
    values = [f"v{k % 7}" for k in range(30)]
    assert sorted(Dataset.parallelize(spark, values).collect()) == sorted(values)


def test_word_count(spark):
    words = Dataset.parallelize(spark, LINES).flat_map(lambda v: F.split(v, " "))
    counts = words.map_to_pair(lambda v: v, lambda v: F.lit("1")).aggregate_by_key(lambda v: F.sum(v.cast("int")))
    assert dict(counts.collect()) == {"red": 4, "blue": 4, "green": 3, "violet": 1}


def test_python_flat_map_and_partitions(spark):
    data = Dataset.parallelize(spark, LINES).flat_map_python(str.split)
    assert Counter(data.collect()) == Counter(w for line in LINES for w in line.split())
    assert sorted(data.map_partitions_python(lambda vs: (v + "_processed" for v in vs)).take(100)) == sorted(w + "_processed" for line in LINES for w in line.split())


def test_intersection(spark):
    left = Dataset.parallelize(spark, "oak Ash elm fir yew pine".split())
    right = Dataset.parallelize(spark, "oak ash elm beech yew Pine".split())
    assert sorted(left.intersection(right).collect()) == ["elm", "oak", "yew"]


def test_intersection_of_values_with_spaces(spark):
    both = Dataset.parallelize(spark, ["a b", "a b", "c+d"])
    assert sorted(both.intersection(both).collect()) == ["a b", "c+d"]


def test_group_by(spark):
    trees = "Maple maple Mahogany Cedar Cherry cedar1 Cedrus Alder alder22".split()
    found = dict(Dataset.parallelize(spark, trees).group_by(lambda v: F.substring(v, 1, 3)).collect())
    assert found == {"Map": "Maple", "map": "maple", "Mah": "Mahogany", "Ced": "Cedar,Cedrus", "Che": "Cherry", "ced": "cedar1", "Ald": "Alder", "ald": "alder22"}


def test_fold(spark, monkeypatch):
    digits = [str(random.Random(3).randint(0, 9)) for _ in range(25)]
    data = Dataset.parallelize(spark, digits)
    total = data.fold(F.lit("0"), lambda a, b: (a.cast("int") + b.cast("int")).cast("string"))
    assert int(total) == sum(map(int, digits)) == data.fold_sum()
    many = Dataset(spark.range(0, 5000, 1, 7).selectExpr("cast(id as string) as value"))
    monkeypatch.setattr(dataset, "FOLDED", 16)
    assert many.fold(F.lit("0"), lambda a, b: (a.cast("int") + b.cast("int")).cast("string")) == str(5000 * 4999 // 2)
    assert Dataset.parallelize(spark, []).fold(F.lit("zero"), lambda a, b: F.concat(a, b)) == "zero"


def test_sample_and_take(spark):
    data = Dataset.parallelize(spark, [str(k) for k in range(3500)])
    assert abs(data.sample(0.7, 11).count() - 2450) < 250
    assert len(data.take(4)) == 4 and data.take(0) == [] and len(Dataset.parallelize(spark, ["a"]).take(30)) == 1
    with pytest.raises(ValueError):
        data.take(-1)


def test_pairs(spark):
    pairs = PairDataset.parallelize(spark, [("a", "b"), ("cc", "d")])
    assert sorted(pairs.flat_map(lambda k, v: F.array(F.concat(k, v), F.concat(v, k))).collect()) == ["ab", "ba", "ccd", "dcc"]
    assert pairs.sorted().first()["key"] == "a"


def test_join_is_a_product_per_key(spark):
    left = PairDataset.parallelize(spark, [("k", "1"), ("k", "2"), ("x", "3")])
    right = PairDataset.parallelize(spark, [("k", "7"), ("k", "8"), ("y", "9")])
    assert sorted(left.join(right).collect()) == [("k", "1,7"), ("k", "1,8"), ("k", "2,7"), ("k", "2,8")]


def test_cogroup_has_empty_sides(spark):
    left = PairDataset.parallelize(spark, [("k", "2"), ("k", "1"), ("x", "3")])
    right = PairDataset.parallelize(spark, [("k", "7"), ("y", "9")])
    assert dict(left.cogroup(right).collect()) == {"k": "[1,2],[7]", "x": "[3],[]", "y": "[],[9]"}


def test_fold_by_key(spark):
    pairs = PairDataset.parallelize(spark, [("A", "3"), ("A", "4"), ("B", "5")])
    assert dict(pairs.fold_by_key(F.lit("0"), lambda a, b: (a.cast("int") + b.cast("int")).cast("string")).collect()) == {"A": "7", "B": "5"}


def test_destroyed(spark):
    data = Dataset.parallelize(spark, ["a"])
    data.destroy()
    for use in (data.count, data.collect, data.distinct):
        with pytest.raises(Destroyed):
            use()


def test_repartitioning_changes_nothing(spark):
    data = Dataset.parallelize(spark, LINES)
    spread = Dataset(data.df.repartition(7))
    key = lambda v: F.substring(v, 1, 2)
    assert sorted(data.group_by(key).collect()) == sorted(spread.group_by(key).collect())


def test_job_context(spark, tmp_path):
    from textloom.operators.context import Context

    def job(context, arguments):
        context.store.save("words", context.parallelize(arguments).df.withColumnRenamed("value", "key"))
        context.set_concurrency_level(4)
        found = context.from_table("words", F.when(F.col("key") != "b", F.col("key")))
        context.output("arguments: " + ",".join(sorted(found.collect())))

    assert Context.run(spark, str(tmp_path), job, ["c", "b", "a"]) == "arguments: a,c"
    with pytest.raises(ZeroDivisionError):
        Context.run(spark, str(tmp_path), lambda c, a: 1 / 0, [])

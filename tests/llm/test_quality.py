"""Quality classifier: held-out accuracy, formulas, odd input."""

import zlib

import numpy as np
import pytest

from textloom.llm import quality

from .conftest import ODD


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.98
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good[:200]]) > 0.99
    assert len({round(s, 6) for s in good}) > 0.9 * len(set(good))  # they rank


def test_scores_are_log_density_differences():
    rng = np.random.default_rng(6)
    x = {c: rng.normal(c, 1 + c, (300, quality.N)) for c in (0, 1)}
    model = quality.Discriminant({c: (300.0, v.sum(0), v.T @ v) for c, v in x.items()})
    at, cov = rng.normal(0, 2, (20, quality.N)), {c: np.cov(v.T, bias=True) for c, v in x.items()}
    pooled = (cov[0] + cov[1]) / 2 + 1e-6 * np.eye(quality.N)
    scale = np.sqrt(np.diag(pooled))
    value = {}
    for c in (0, 1):
        mixed = ((1 - quality.POOLED) * cov[c] + quality.POOLED * pooled) / np.outer(scale, scale)
        mixed = (1 - quality.ROUND) * mixed + quality.ROUND * np.trace(mixed) / quality.N * np.eye(quality.N)
        z = (at - x[c].mean(0)) / scale
        value[c] = -0.5 * np.einsum("ni,ij,nj->n", z, np.linalg.inv(mixed), z) - 0.5 * np.linalg.slogdet(mixed)[1]
    assert model.differences(at) == pytest.approx(value[1] - value[0], abs=1e-9)
    plain = 1 / (1 + np.exp(value[0] - value[1]))
    scores = model.scores(at)
    assert ((scores >= quality.THRESHOLD) == (plain >= quality.THRESHOLD)).all()
    assert (np.argsort(scores) == np.argsort(value[1] - value[0])).all() and model.temper > 1
    own = {c: model.differences(v).mean() for c, v in x.items()}  # what the moments alone let expect
    assert model.temper == pytest.approx(min(map(abs, own.values())) / 4)


def test_labels_of_the_held_out_fold_do_not_train(spark, small, folder):
    docs, texts = small
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = [d for d, _ in texts if zlib.crc32(str(d).encode()) % 5 == 0]
    flipped = labels.selectExpr("doc_id", f"CASE WHEN doc_id IN ({', '.join(map(str, held))}) THEN 1 - quality ELSE quality END AS quality")
    score = lambda l: {r["doc_id"]: round(r["score"], 9) for r in quality.classify(docs, l).collect()}  # noqa: E731,E741
    assert score(labels) == score(flipped)


def test_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (4, 1), (5, 0), (6, 0), (7, None), (None, 1), (2, 1), (2, 1), (3, 0), (-3, 1)], "doc_id long, quality int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    assert quality.classify(none, labels).count() == 0
    unlabelled = quality.classify(odd, labels.limit(0)).collect()
    assert {r["score"] for r in unlabelled} == {0.5}
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_statistics_of_the_empty_text():
    assert (quality.statistics(["", " \n"]) == 0).all()

"""Leaks against brute force."""

import random

import pytest

from textloom.llm import decontamination as deco

from .conftest import ODD, documents


@pytest.fixture(scope="module")
def benchmark(spark, folder):
    return spark.read.parquet(f"{folder}/benchmark.parquet")


def holding(texts, items):
    whole = lambda t: f" {' '.join(deco.terms(t or ''))} "
    marks = [(i, whole(t)) for i, t in items]
    return {(d, i) for d, t in texts for i, m in marks if m in whole(t)}


def test_real_documents(small, benchmark):
    docs, texts = small
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    rows = deco.leaks(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == holding(texts, items) and rows
    assert all(0.6 <= r["score"] <= 1.0001 for r in rows)
    scores = {(r["doc_id"], r["item_id"]): r["score"] for r in rows}
    for size in (1500, 700):
        assert {(r["doc_id"], r["item_id"]): r["score"] for r in deco.leaks(docs, benchmark, block_bytes=size).collect()} == pytest.approx(scores, abs=1e-12)
    clean = {r["doc_id"] for r in deco.clean(docs, benchmark).collect()}
    assert clean == {d for d, _ in texts} - {r["doc_id"] for r in rows}


def test_search_equals_scoring_all(small, benchmark):
    """Block-max pruning and essential postings lose nothing above the threshold."""
    import numpy as np
    import pyarrow as pa

    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    index, rng = deco.Index(items), random.Random(8)
    texts = [t for _, t in small[1]]
    for _, item in items:  # items in parts, with foreign words between
        own = item.split()
        texts.append(" ".join(w for w in own if rng.random() < rng.choice([0.5, 0.7, 0.9])))
    distinct, numbers, bounds = deco.numbered_words(pa.array(texts))
    ids = index.number(distinct, {})[numbers]
    real = ids != -2
    bounds, ids = np.concatenate([[0], np.cumsum(real)])[bounds], ids[real]
    want = {}
    for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        for start in range(a, max(b, a + 1), index.stride):
            present = set(ids[start : min(start + 2 * index.stride, b)].tolist())
            scores = {}
            for t in present & set(index.postings):
                for k, w in zip(*index.postings[t][:2]):
                    scores[k] = scores.get(k, 0) + w
            for k, s in scores.items():
                if s >= deco.THRESHOLD:
                    want[d, k] = max(want.get((d, k), 0), s)
    found = {(d, k): s for d, k, s in index.retrieve(ids, bounds)}
    assert set(want) <= set(found) and all(abs(found[x] - want[x]) < 1e-9 for x in want) and len(want) > 10


def test_wand_skips_blocks_and_loses_nothing():
    """Random items and passages: what reaches the threshold is found, and most items are never scored."""
    import numpy as np

    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(400)], k=rng.randint(3, 14)))) for k in range(1500)]
    index = deco.Index(items)
    found = 0
    for _ in range(300):
        base = deco.terms(rng.choice(items)[1])
        passage = [w for w in base if rng.random() < 0.85] + rng.choices(words, k=8)
        ids = np.array([index.vocabulary[w] for w in passage])
        want = {}
        for t in set(ids.tolist()):
            for k, w in zip(*index.postings[t][:2]):
                want[k] = want.get(k, 0.0) + w
        want = {k: s for k, s in want.items() if s >= deco.THRESHOLD - 1e-9}
        assert dict(index.search(ids)) == pytest.approx(want)
        found += len(want)
    assert found > 300 and index.work["skipped"] > 1000 and index.work["scored"] < 0.1 * 300 * 1500


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "Yes."), (3, "!?"), (4, "Is it so? No.")], "item_id long, text string")
    rows = [(1, "someone asked: who wrote Hamlet, and why"), (2, "Hamlet is what who wrote"), (3, "no, or yes"), (4, "he said is it so? no. that was all"), (5, "is it so, asked one; the other said no")]
    found = sorted((r["doc_id"], r["item_id"]) for r in deco.leaks(documents(spark, rows), bench).collect())
    assert found == [(1, 1), (3, 2), (4, 4)]
    assert deco.leaks(documents(spark, rows), bench, min_terms=4).count() == 1


def test_edited_and_partial(spark):
    item = "What colour is the large old house near the river bank today? It is painted in a very pale green."
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (1, item)], "item_id long, text string")
    noise = " ".join(f"filler{k}" for k in range(300))
    rows = [
        (1, f"{noise} {item} {noise}"), (2, f"{noise} {item.upper().replace('?', ' !!')} {noise}"), (3, f"{noise} {item.replace('large', 'big')}"),
        (4, noise), (5, f"{noise} What colour is the house? {noise}"), (6, item.split("?")[1]), (7, "too short"),
    ]
    found = [(r["doc_id"], r["item_id"]) for r in deco.leaks(documents(spark, rows), bench).collect()]
    assert sorted(found) == [(1, 1), (1, 1), (2, 1), (2, 1), (7, 3)]  # the item is there twice; one changed word in twelve is under 0.75


def test_odd(spark, odd, none, benchmark):
    assert deco.leaks(odd, benchmark).count() == 0 and deco.leaks(none, benchmark).count() == 0
    kept = deco.clean(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert deco.leaks(odd, nothing).count() == 0 and deco.clean(odd, nothing).count() == len(ODD)

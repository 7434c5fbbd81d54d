"""Jaccard join against brute force; components; signature trees."""

import random

import numpy as np
import pytest

from textloom.llm import components, jaccard
from textloom.llm.common import join_by_weight
from textloom.llm.words import shingle_sets

from .conftest import ODD, documents


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    sets = [(d, shingles(t)) for d, t in texts]
    label = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (d, _), x in zip(sets, label):
        least[x] = min(least.get(x, d), d)
    return {d: (len(s), least[x]) for (d, s), x in zip(sets, label)}


def check(docs, texts):
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()} == brute(texts)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randint(0, 999)}"
    return " ".join(words)


@pytest.mark.parametrize("seed", range(2))
def test_families(spark, seed):
    rng = random.Random(seed)
    texts = []
    for size in (3, 6, 12, 40, 80, 250):
        base = [f"w{rng.randint(0, 300)}" for _ in range(size)]
        texts += [edited(rng, base, rng.randint(0, max(1, size // 25))) for _ in range(14)] + [" ".join(base)] * 3
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    check(documents(spark, rows), rows)


def test_common_passage(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, passage + " " + " ".join(f"o{rng.randint(0, 10**6)}" for _ in range(rng.choice([5, 10, 25, 100])))) for k in range(120)]
    check(documents(spark, rows), rows)


def test_real_documents(spark, small):
    check(small[0], small[1])


def test_odd(odd, none):
    rows = [(d, t) for d, t in ODD if d not in (None, 4)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(odd).collect()}
    assert {d: found[d] for d, _ in rows} == brute(rows)
    assert found[None][1] is None and found[4][1] == 4 and found[1] == (0, 1)
    assert jaccard.join(none).count() == 0
    kept = jaccard.keep_one(odd)
    # the row that is there twice stays once, the rows without words all stay
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1 and jaccard.keep_one(none).count() == 0


def test_one_row_of_a_component_stays(spark):
    text = "a text of some length that is there again and again without end"
    rows = [(4, text), (4, text), (4, text + " now"), (None, text), (None, text), (9, text), (1, ""), (1, ""), (None, None), (5, "all else"), (5, "quite other words")]
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(documents(spark, rows)).collect()), key=str)
    assert kept in [sorted([(4, t), (1, ""), (1, ""), (None, None), (5, "all else"), (5, "quite other words")], key=str) for t in (text, text + " now")]
    nameless = [(None, text)] * 3 + [(None, text + " now")]
    assert jaccard.keep_one(documents(spark, nameless)).count() == 1
    found = jaccard.join(documents(spark, rows)).collect()
    assert len(found) == len(rows) and sum(r["component_id"] == 4 for r in found) == 6


def test_hot_keys_are_broadcast(spark):
    left = spark.createDataFrame([(1, k) for k in range(3000)] + [(k, k) for k in range(2, 500)], "key long, v long")
    right = spark.createDataFrame([(1, "hot", 3000)] + [(k, str(k), 1) for k in range(2, 300)], "key long, name string, n long")
    found = join_by_weight(left, right, ["key"], "n", 3498)
    assert found.count() == 3000 + 298 and {r["name"] for r in found.where("key = 1").collect()} == {"hot"}


def test_a_cluster_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, edited(rng, base, rng.randint(0, 5))) for k in range(60)]
    monkeypatch.setattr(jaccard, "CLUSTER_SHINGLES", 1500)
    check(documents(spark, rows), rows)


def test_tree_loses_nothing():
    rng = np.random.default_rng(2)
    sets = []
    for size in (30, 300, 3000):
        base = rng.integers(0, 1 << 63, size).astype(np.uint64)
        for _ in range(25):
            own = np.where(rng.random(size) < 0.08, rng.integers(0, 1 << 63, size).astype(np.uint64), base)
            sets.append(np.unique(own[: rng.integers(int(size * 0.8), size + 1)]))
    sizes = np.array([len(s) for s in sets])
    link = lambda p, q: jaccard.linked(sets[p], sets[q])
    found = jaccard.spanning(sizes, [jaccard.signature(s) for s in sets], link)

    def labels(pairs):
        x = list(range(len(sets)))
        for p, q in pairs:
            x = [x[p] if v == x[q] else v for v in x]
        return [x.index(v) for v in x]

    assert labels(found) == labels([(p, q) for p in range(len(sets)) for q in range(p) if link(p, q)])
    assert len(found) < len(sets)


def test_prefixes_of_links_meet():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, int(rng.integers(0, 4))).astype(np.uint64)]))
        if len(b) and jaccard.linked(a, b):
            hot = np.sort(rng.choice(a, min(len(a), 3), replace=False))
            rank = rng.permutation(len(hot))
            assert set(jaccard.prefix(a, hot, rank)) & set(jaccard.prefix(b, hot, rank))


@pytest.mark.parametrize("in_task", [0, 1 << 20])
def test_components(spark, in_task):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 400)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)]
    rng.shuffle(edges)
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(6), in_task).collect()}
    label = {n: n for e in edges for n in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert found == {n: x for n, x in label.items() if n != x}


def test_shingle_sets_match_words():
    import pyarrow as pa

    texts = [t for _, t in ODD] + ["A b\x0bC\x0cd\re é f", "a b c d e", "a B c D E"]
    assert [len(s) for s in shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]
    assert (shingle_sets(pa.array(texts))[-1] == shingle_sets(pa.array(texts))[-2]).all()

"""Line dedup against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from textloom.llm import lines

from .conftest import ODD, documents


def words(line):
    return tuple(line.encode().lower().split())


def unit(w):
    """How the words of a line are compared: (unit, sequence), or None where it has no near lines."""
    if len(w) >= lines.NEAR_WORDS:
        return "word", w
    text = b" ".join(w).decode()
    return ("character", text) if len(text) >= lines.NEAR_CHARS else None


def expected(texts, edits=1):
    first, rows = {}, []
    for doc_id, text in texts:
        for k, line in enumerate((text or "").split("\n")):
            if w := words(line):
                rows.append((doc_id, k, w))
                first.setdefault(w, (doc_id, k))
    units = {w: unit(w) for w in first}
    near = set()
    for a, x in units.items():
        for b, y in units.items():
            if x and y and first[b] < first[a] and x[0] == y[0] and abs(len(x[1]) - len(y[1])) <= edits:
                if len(set(x[1]) ^ set(y[1])) <= 2 * edits and distance(x[1], y[1]) <= edits:
                    near.add(a)
    out = defaultdict(set)
    for doc_id, k, w in rows:
        if first[w] != (doc_id, k) or w in near:
            out[doc_id].add(k)
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def check(spark, texts, edits=1):
    docs = documents(spark, texts)
    found = {r["doc_id"]: r["dropped"] for r in lines.decisions(docs, edits=edits).collect()}
    want = expected(texts, edits)
    assert found == {d: ",".join(map(str, sorted(want[d]))) for d, _ in texts}
    kept = {r["doc_id"]: r["text"] for r in lines.dedup(docs, edits=edits).collect()}
    for doc_id, text in texts:
        own = (text or "").split("\n")
        left = [x for k, x in enumerate(own) if k not in want[doc_id]]
        if not want[doc_id]:
            assert kept[doc_id] == text
        elif any(x.strip() for x in left):
            assert kept[doc_id] == "\n".join(left)
        else:
            assert doc_id not in kept


def test_within():
    rng = random.Random(4)
    for _ in range(3000):
        a, b = ([rng.choice("xyz") for _ in range(rng.randint(0, 6))] for _ in range(2))
        assert [lines.within(a, b, k) for k in (1, 2, 3)] == [distance(a, b) <= k for k in (1, 2, 3)]


def test_variants_of_two_edits():
    """Two sequences have compatible kinds under one key exactly if they are within two edits."""
    rng = random.Random(5)
    for _ in range(1500):
        a, b = ([rng.choice([3, 5, 7]) for _ in range(rng.randint(2, 6))] for _ in range(2))
        x, y = (lines.variants(np.array(s, dtype=np.uint64), 2) for s in (a, b))
        joined = any(k in y and x[k][0] == y[k][0] and x[k][0] + x[k][1] + y[k][1] <= 2 for k in x)
        assert joined == (distance(a, b) <= 2), (a, b)


def test_short_lines(spark):
    texts = [(1, "ok\nPage one of this\nof the,\n  \nof the,"), (2, "OK\nof  the,\nyes"), (3, "A line of some letters.\nyes sir"), (4, "A line of some letter.\nx"), (5, "A line of some metters\nA LINE of some letters.\ny")]
    found = {r["doc_id"]: (r["n_lines"], r["dropped"], r["earlier"]) for r in lines.decisions(documents(spark, texts)).collect()}
    assert found == {1: (4, "4", "1"), 2: (3, "0,1", "1"), 3: (2, "", ""), 4: (2, "0", "3"), 5: (3, "1", "3")}
    check(spark, texts)


def test_two_edits(spark):
    base = "one two three four five six seven eight nine ten"
    texts = [(1, base), (2, base.replace("two", "2").replace("nine", "9")), (3, base.replace("two ", "").replace("nine", "9")), (4, base.replace("two", "2").replace("five", "5").replace("nine", "9")), (5, "some letters in a line"), (6, "somme letter in a line")]
    check(spark, texts, 2)
    check(spark, texts, 1)


@pytest.mark.parametrize("seed", range(3))
def test_random_edits(spark, seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.choice([3, 7, 8, 9, 15, 16, 17, 31, 32, 33]))] for _ in range(14)]
    texts = []
    for doc in range(40):
        own = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2])):
                k = rng.randrange(len(line))
                line[k : k + rng.choice([0, 1])] = [rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(rng.choice([0, 1]))]
            own.append(" ".join(line))
        texts.append((doc, "\n".join(own)))
    check(spark, texts)


def test_one_hot_line(spark):
    check(spark, [(k, f"This very common line has ten words in it always.\nown text number {k} is here\nPage {k} of the long report that everyone has read twice") for k in range(60)])


def test_real_documents(spark, small):
    check(spark, small[1])


def test_odd(odd, none):
    found = {r["doc_id"]: r for r in lines.decisions(odd).collect()}
    assert found[1]["n_lines"] == 0 and found[5]["n_dropped"] == 0 and found[None]["n_lines"] == 1 and found[4]["n_dropped"] == 0 and found[4]["n_lines"] == 2
    kept = lines.dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert lines.decisions(none).count() == 0 and lines.dedup(none).count() == 0


def test_rows_that_share_a_doc_id_or_have_none(spark):
    near = "one two three four five six seven eight nine"
    texts = [(1, f"{near} ten\nunlike all of the others"), (7, "a b c d e f g h i j\nx"), (7, f"{near} eleven\nx"), (9, "a b c d e f g h i j k")]
    texts += [(None, f"{near} ten\nonly here {k}\nsaid by all without a name") for k in range(40)]
    docs = documents(spark, texts)
    found = {r["doc_id"]: r for r in lines.decisions(docs).collect()}
    assert {k: found[k]["dropped"] for k in (1, 9)} == {1: "", 9: "0"}
    assert found[7]["n_lines"] == 4 and found[7]["n_dropped"] == 2 and found[None]["n_dropped"] == 40 + 39
    kept = [(r["doc_id"], r["text"]) for r in lines.dedup(docs).collect()]
    assert (1, texts[0][1]) in kept
    assert sum("said by all" in t for _, t in kept) == 1 and sum("only here" in t for _, t in kept) == 40
    assert sum(t.split("\n").count("x") for _, t in kept) == 1

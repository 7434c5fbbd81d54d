"""Benchmark decontamination: BM25 over test items, block-max WAND, then overlap of question and answer.

The index holds, for each term, its items in order and their BM25 weights, divided by the item's own total so
that an item scores 1 against itself. Document frequencies, the number of items, their mean and greatest length
are those of the whole benchmark. Every training document is cut into overlapping passages, twice as long as the
longest item and half that apart, so any stretch as long as an item lies within one passage. Every passage is
a query, and every item that reaches the threshold is retrieved:

* Of each item's weights the lightest are set aside as long as they sum to less than LIGHT. A passage can reach
  the threshold only if the others, the essential postings, bring the rest. A batch of passages meets these at once.
* Passages that pass are searched by block-max WAND: cursors in item order, the pivot where summed term maxima
  reach the threshold, blocks of items skipped whose own maxima don't, the others scored in full.

An item is verified in a document if OVERLAP of its question's word five-grams and of its answer's (the last
sentence) are in the document, or that share of the whole item's; an item of under five words, if the document
has its words in a row.

Defined cases: null or empty texts have no passages; items without a word, or of under ``min_terms``, are not
searched for (one word is enough by default: a benchmark of common words would mark ordinary texts); repeated
items are reported each; repeated rows are repeated; an empty benchmark or table gives no rows. Benchmarks are
taken in blocks of ``block_bytes`` of text, each a pass over the documents, so neither the driver nor a worker
holds more than one block's index; scores don't depend on the blocks.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, slices
from textloom.llm.words import FACTORS, SHINGLE, mixed, numbered_words

K1, B = 1.2, 0.75
THRESHOLD, LIGHT, OVERLAP = 0.6, 0.35, 0.75
MIN_TERMS = 1
BLOCK_ITEMS = 16
BLOCK_BYTES = 4 << 20
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\s*\n+\s*")


def term(word: bytes) -> str:
    """A white-space word, lower-cased, without signs at its ends."""
    return EDGE.sub("", word.decode("utf-8", "replace").lower())


def terms(text: str) -> list[str]:
    return [t for t in map(term, text.encode("utf-8", "surrogatepass").lower().split()) if t]


def question_and_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last; an item of one sentence is both."""
    parts = [p for p in SENTENCE.split(text.strip()) if terms(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def grams(ids: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of `size` term numbers; runs with an unknown term (-1) are left out."""
    n = len(ids) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    runs, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(size):
        runs += (ids[k : k + n] + 1).astype(np.uint64) * FACTORS[k]
        known &= ids[k : k + n] >= 0
    return mixed(runs)[known]


@dataclass
class Statistics:
    """Of a whole benchmark: number of items, their mean and greatest number of terms, and in how many items
    each term is (those of one block's vocabulary are enough)."""

    items: int
    mean: float
    longest: int
    frequency: dict[str, int]

    @classmethod
    def of(cls, texts: list[str]) -> "Statistics":
        words = [w for t in texts if (w := terms(t or ""))]
        return cls(len(words), sum(map(len, words)) / max(1, len(words)), max(map(len, words), default=1), Counter(t for w in words for t in set(w)))


class Cursor:
    """A term's postings in item order, and where the search stands in them."""

    __slots__ = ("items", "weights", "most", "blocks", "at", "item")

    def __init__(self, posting: tuple) -> None:
        self.items, self.weights, self.most, self.blocks = posting
        self.at, self.item = 0, self.items[0]

    def seek(self, item: int) -> None:
        """To the first posting of at least this item; beyond the last one, item is None."""
        self.at = bisect_left(self.items, item, self.at)
        self.item = self.items[self.at] if self.at < len(self.items) else None


class Index:
    """Inverted index of one block of items."""

    def __init__(self, items: list[tuple[int, str]], whole: Statistics | None = None, min_terms: int = MIN_TERMS) -> None:
        self.items = [(i, text) for i, text in items if len(terms(text or "")) >= max(1, min_terms)]
        whole = whole or Statistics.of([text for _, text in self.items])
        self.work: Counter = Counter()
        words = [terms(text) for _, text in self.items]
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for w in words for t in w}))}
        ids = [np.array([self.vocabulary[t] for t in w]) for w in words]
        self.stride = max(32, whole.longest)
        self.parts = []
        for (_, text), own in zip(self.items, ids):
            pair = [np.array([self.vocabulary[t] for t in terms(p)], dtype=np.int64) for p in question_and_answer(text)]
            self.parts.append([(np.unique(grams(p, min(SHINGLE, len(p)))), min(SHINGLE, len(p))) for p in (*pair, own)])
        df = np.array([whole.frequency[t] for t in self.vocabulary])  # in the order of their numbers
        idf = np.log1p((whole.items - df + 0.5) / (df + 0.5)) if len(df) else df
        postings: dict[int, list[tuple[int, float]]] = {}
        essential = []
        self.needed = np.zeros(len(ids))
        for k, own in enumerate(ids):
            t, tf = np.unique(own, return_counts=True)
            weight = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(own) / whole.mean))
            weight /= weight.sum()
            for a, w in zip(t.tolist(), weight.tolist()):
                postings.setdefault(a, []).append((k, w))
            order = np.argsort(weight, kind="stable")
            light = np.cumsum(weight[order]) < LIGHT
            self.needed[k] = THRESHOLD - weight[order][light].sum() - 1e-9
            essential += [(int(t[x]), k, float(weight[x])) for x in order[~light]]
        essential.sort()
        self.essential_term, self.essential_item = (np.array([e[c] for e in essential], dtype=np.int64) for c in (0, 1))
        self.essential_weight = np.array([e[2] for e in essential])
        self.first = np.searchsorted(self.essential_term, np.arange(len(self.vocabulary) + 1))
        #: By term: items in order, weights, their maximum, and the maximum of each block of items.
        self.postings: dict[int, tuple[list[int], list[float], float, dict[int, float]]] = {}
        for t, own in postings.items():
            maxima: dict[int, float] = {}
            for k, w in own:
                maxima[k // BLOCK_ITEMS] = max(maxima.get(k // BLOCK_ITEMS, 0.0), w)
            self.postings[t] = [k for k, _ in own], [w for _, w in own], max(w for _, w in own), maxima

    def number(self, distinct: list[bytes], cache: dict[bytes, int]) -> np.ndarray:
        """Term numbers of distinct words: -1 unknown, -2 only signs."""
        if len(cache) > 500_000:
            cache.clear()
        for w in distinct:
            if w not in cache:
                t = term(w)
                cache[w] = self.vocabulary.get(t, -1) if t else -2
        return np.fromiter(map(cache.__getitem__, distinct), dtype=np.int64, count=len(distinct))

    def search(self, passage: np.ndarray) -> list[tuple[int, float]]:
        """(item, score) of every item that reaches the threshold against a passage's terms, by block-max WAND."""
        least = THRESHOLD - 1e-9
        cursors = [Cursor(self.postings[t]) for t in np.unique(passage).tolist() if t >= 0]
        out = []
        while True:
            cursors = sorted((c for c in cursors if c.item is not None), key=lambda c: c.item)
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c.most
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = cursors[pivot].item
            while pivot + 1 < len(cursors) and cursors[pivot + 1].item == item:
                pivot += 1
            block = item // BLOCK_ITEMS
            if sum(c.blocks.get(block, 0.0) for c in cursors[: pivot + 1]) < least:
                # none of these terms' items up to the block's end can reach it, unless another term comes in
                self.work["skipped"] += 1
                target = (block + 1) * BLOCK_ITEMS
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1].item)
                for c in cursors[: pivot + 1]:
                    c.seek(target)
            elif cursors[0].item == item:
                own = cursors[: pivot + 1]
                score = sum(c.weights[c.at] for c in own)
                self.work["scored"] += 1
                if score >= least:
                    out.append((item, score))
                for c in own:
                    c.seek(item + 1)
            else:
                for c in cursors[:pivot]:
                    c.seek(item)

    def retrieve(self, ids: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, float]]:
        """(document, item, best score) over all passages of a batch of documents."""
        start, stop = self.first[np.maximum(ids, 0)], self.first[np.maximum(ids, 0) + 1]
        at = np.flatnonzero((ids >= 0) & (stop > start))
        if not len(at):
            return []
        doc = np.searchsorted(bounds, at, "right") - 1
        slot = (at - bounds[doc]) // self.stride
        # passage k covers words from k to k + 2 strides: a word is in passages slot - 1 and slot
        base = np.concatenate([[0], np.cumsum((np.diff(bounds) + self.stride - 1) // self.stride)])
        count = stop[at] - start[at]
        which = np.repeat(start[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
        own, place = np.repeat(base[doc] + slot, count), np.repeat(slot, count)
        passage = np.concatenate([own, own[place > 0] - 1])
        posting = np.concatenate([which, which[place > 0]])
        pairs = np.unique(passage * len(self.essential_term) + posting)
        passage, posting = pairs // len(self.essential_term), pairs % len(self.essential_term)
        item = self.essential_item[posting]
        order = np.lexsort((item, passage))
        passage, item, weight = passage[order], item[order], self.essential_weight[posting[order]]
        new = np.flatnonzero(np.concatenate([[True], (passage[1:] != passage[:-1]) | (item[1:] != item[:-1])]))
        reached = np.add.reduceat(weight, new) >= self.needed[item[new]]
        best: dict[tuple[int, int], float] = {}
        for p in np.unique(passage[new[reached]]).tolist():
            d = int(np.searchsorted(base, p, "right")) - 1
            a = bounds[d] + (p - base[d]) * self.stride
            for k, s in self.search(ids[a : min(a + 2 * self.stride, bounds[d + 1])]):
                best[d, k] = max(best.get((d, k), 0.0), s)
        return [(d, k, s) for (d, k), s in best.items()]

    def verified(self, ids: np.ndarray, found: list[tuple[int, float]]) -> list[tuple[int, float, float, float]]:
        """(item, score, question overlap, answer overlap) of items whose text is in the document."""
        held: dict[int, np.ndarray] = {}
        out = []
        for k, score in found:
            shares = []
            for own, size in self.parts[k]:
                if size not in held:
                    held[size] = grams(ids, size)
                shares.append(float(np.isin(own, held[size]).mean()))
            short = self.parts[k][2][1] < SHINGLE
            if shares[2] >= OVERLAP or not short and min(shares[:2]) >= OVERLAP:
                out.append((k, score, *shares[:2]))
        return out

    def scan(self, texts: pa.Array, cache: dict[bytes, int]) -> list[tuple[int, int, float, float, float]]:
        """(document, item_id, score, question overlap, answer overlap) over a batch of whole texts."""
        distinct, index, bounds = numbered_words(texts)
        ids = self.number(distinct, cache)[index]
        real = ids != -2
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        ids = ids[real]
        per_doc: dict[int, list] = {}
        for d, k, s in self.retrieve(ids, bounds):
            per_doc.setdefault(d, []).append((k, s))
        return [(d, self.items[k][0], s, q, a) for d in sorted(per_doc) for k, s, q, a in self.verified(ids[bounds[d] : bounds[d + 1]], per_doc[d])]


def term_rows(items: DataFrame) -> DataFrame:
    """term, n: a row for each distinct term of an item, and one without a term for its number of terms."""

    def run(batches):
        for batch in batches:
            found: list[tuple[str | None, int]] = []
            for text in batch.column("text").to_pylist():
                own = terms(text or "")
                if own:
                    found += [(None, len(own)), *[(t, 1) for t in set(own)]]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=["term", "n"])

    return items.select("text").mapInArrow(run, "term string, n long")


def indexes(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, min_terms: int = MIN_TERMS):
    """The benchmark's indexes, one block of items in the driver's memory at a time, with the whole's statistics."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = cut(term_rows(items), "item-terms")
    totals = rows.where("term is null").agg(F.count(F.lit(1)), F.avg("n"), F.max("n")).first()
    if not totals[0]:
        return
    frequency = rows.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        found = own.collect()
        # no more terms than the block's text has
        counts = frequency.join(term_rows(own).where("term is not null").select("term").distinct(), "term", "left_semi").collect() if found else []
        whole = Statistics(totals[0], float(totals[1]), int(totals[2]), {r["term"]: r["df"] for r in counts})
        index = Index(sorted(((r["item_id"], r["text"]) for r in found), key=lambda r: (r[0] is None, r[0] or 0, r[1])), whole, min_terms)
        if index.items:
            yield index


LEAKS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, min_terms: int = MIN_TERMS) -> DataFrame:
    """A row for each document and item whose text the document holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], LEAKS)

    def passes(index: Index):
        def run(batches):
            cache: dict[bytes, int] = {}
            for batch in batches:
                for part in slices(batch):
                    rows = index.scan(part.column("text"), cache)
                    ids = part.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                    rest = [pa.array([r[c] for r in rows], t) for c, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64()))]
                    yield pa.RecordBatch.from_arrays([ids, *rest], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return docs.mapInArrow(run, LEAKS)

    found = [passes(index) for index in indexes(benchmark, block_bytes, min_terms)]
    for k, more in enumerate(found):
        out = more if k == 0 else out.union(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, min_terms: int = MIN_TERMS) -> DataFrame:
    """The documents that hold no item, with all their columns; no shuffle."""

    def holds(index: Index):
        @F.pandas_udf("boolean")
        def leaking(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cache: dict[bytes, int] = {}
            for texts in batches:
                out, at = np.zeros(len(texts), dtype=bool), 0
                batch = pa.record_batch([pa.array(texts, pa.string(), from_pandas=True)], names=["text"])
                for part in slices(batch):
                    out[sorted({at + r[0] for r in index.scan(part.column("text"), cache)})] = True
                    at += part.num_rows
                yield pd.Series(out)

        return leaking

    for index in indexes(benchmark, block_bytes, min_terms):
        docs = docs.where(~holds(index)(F.col("text")))
    return docs

"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian over the same statistics of the text. Its covariance is shrunk towards the
pooled one and towards a multiple of the identity, so that few labels or degenerate statistics can't
make it singular. The score is the logistic of the log-density difference: two Mahalanobis distances
by cached inverse Cholesky factors, the log determinants and the class priors. Differences are far larger
than a logistic can tell apart, so they are tempered around the threshold, which decides as it did: divided
by a quarter of the smaller class's expected difference. Scores then rank documents.

Labels come only from rows whose crc32 of the doc_id as text leaves a remainder other than 0 by 5.
All labelled rows are used: sums and cross products are added up per class by Spark, and only those
(some 150 numbers per class) reach the driver. Language, source, doc_id and labels are no inputs.

Defined cases: a null text is empty; the empty text has its own statistics (zeros) and is scored like
any other; null labels or doc_ids don't train; without labels of one class the score is that class's
smoothed share; repeated label rows count as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, slices

FOLDS = 5
THRESHOLD = 0.3
POOLED, ROUND = 0.2, 0.05
NAMES = ("words", "word_length", "distinct", "upper", "digits", "symbols", "bangs", "pipes", "stops", "high", "lines", "tails", "repeats", "doubles")
#: A share counts as if so many bytes, words or lines of ordinary text stood before the text: shares of
#: very short texts then say little instead of being extreme.
EXTRA_BYTES, EXTRA_WORDS, EXTRA_LINES = 200, 30, 8
USUAL = np.array([0.02, 0.002, 0.001, 0.0005, 0.0005, 0.02, 0.01, 0.004])
USUAL_WORD, USUAL_TAILS = 6.0, 0.12
N = len(NAMES)

_BYTES = np.arange(256)
_is = lambda chars: np.isin(_BYTES, list(chars.encode())).astype(np.float64)
CLASSES = np.stack([
    _is("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _is("0123456789"), _is("#$%&*+/<=>@[\\]^_`{}~"), _is("!?"), _is("|"), _is(".,;:"),
    ((_BYTES >= 0xC0)).astype(np.float64), _is("\n"),
])


def statistics(texts: list[str]) -> np.ndarray:
    """(n, N) transformed statistics of whole texts."""
    out = np.zeros((len(texts), N))
    for k, text in enumerate(texts):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        words = text.split()
        if not words:
            continue
        size, n = len(raw), len(words)
        counts = (CLASSES @ np.bincount(raw, minlength=256) + USUAL * EXTRA_BYTES) / (size + EXTRA_BYTES)
        own = text.split("\n")
        tails = (sum(not w[-1].isalnum() for w in words) + USUAL_TAILS * EXTRA_WORDS) / (n + EXTRA_WORDS)
        out[k] = (
            np.log1p(n), np.log((size + USUAL_WORD * EXTRA_WORDS) / (n + EXTRA_WORDS)), np.log((len(set(words)) + EXTRA_WORDS) / (n + EXTRA_WORDS)) / np.log(n + 2),
            *np.sqrt(counts), np.sqrt(tails), np.sqrt((len(own) - len(set(own))) / (len(own) + EXTRA_LINES)),
            np.sqrt(sum(map(eq, words, words[1:])) / (n + EXTRA_WORDS / 3)),
        )
    return out


class Discriminant:
    """Fitted model: means, inverse Cholesky factors, and what is constant in the log densities."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> None:
        self.counts = {c: moments[c][0] if c in moments else 0.0 for c in (0, 1)}
        self.share = (self.counts[1] + 1) / (sum(self.counts.values()) + 2)
        self.parts, self.temper = None, 1.0
        if min(self.counts.values()) < 2:
            return
        means, scatter = {}, {}
        for c, (n, total, cross) in moments.items():
            means[c] = total / n
            scatter[c] = cross - n * np.outer(means[c], means[c])
        pooled = (scatter[0] + scatter[1]) / sum(self.counts.values()) + 1e-6 * np.eye(N)
        scale = np.sqrt(np.diag(pooled))  # statistics differ in scale: shrink what is standardised
        unit = pooled / np.outer(scale, scale)
        self.parts = {}
        for c in (0, 1):
            own = scatter[c] / self.counts[c] / np.outer(scale, scale)
            mixed = (1 - POOLED) * own + POOLED * unit
            mixed = (1 - ROUND) * mixed + ROUND * np.trace(mixed) / N * np.eye(N)
            factor = np.linalg.cholesky(mixed)
            self.parts[c] = means[c], np.linalg.inv(factor) / scale[None, :], -np.log(np.diag(factor)).sum() + np.log(self.counts[c])

        expected = []
        for c in (0, 1):
            far = {k: ((factor @ (means[c] - mean)) ** 2).sum() + np.trace(factor @ (scatter[c] / self.counts[c]) @ factor.T) for k, (mean, factor, _) in self.parts.items()}
            expected.append(abs(self.parts[1][2] - self.parts[0][2] - 0.5 * (far[1] - far[0])))
        self.temper = max(1.0, min(expected) / 4)

    def differences(self, stats: np.ndarray) -> np.ndarray:
        """Log-density differences, class 1 against class 0."""
        density = {c: base - 0.5 * (((stats - mean) @ factor.T) ** 2).sum(axis=1) for c, (mean, factor, base) in self.parts.items()}
        return density[1] - density[0]

    def scores(self, stats: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(stats), self.share)
        edge = np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip((self.differences(stats) - edge) / self.temper + edge, -500, 500)))


def remainder() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and its text's statistics as an array."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                stats = statistics([t or "" for t in part.column("text").to_pylist()])
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, N, dtype=np.int32)), pa.array(stats.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, stats array<double>")


def fit(measured: DataFrame, labels: DataFrame) -> Discriminant:
    """Add up moments per class over all labelled rows outside the held-out fold."""
    known = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & (remainder() != 0))
    pairs = [(i, j) for i in range(N) for j in range(i, N)]
    x = lambda i: F.col("stats")[i]
    rows = (
        measured.join(known, "doc_id")
        .groupBy("quality")
        .agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x(i)) for i in range(N)]).alias("total"), F.array(*[F.sum(x(i) * x(j)) for i, j in pairs]).alias("cross"))
        .collect()  # two rows
    )
    moments = {}
    for r in rows:
        cross = np.zeros((N, N))
        for (i, j), v in zip(pairs, r["cross"]):
            cross[i, j] = cross[j, i] = v
        moments[int(r["quality"])] = float(r["n"]), np.array(r["total"]), cross
    return Discriminant(moments)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    measured = cut(measure(docs), "statistics")
    model = fit(measured, labels)

    def run(batches):
        for batch in batches:
            stats = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, N)
            scores = model.scores(stats)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = measured.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    model = fit(cut(measure(docs.select("doc_id", "text")), "statistics"), labels)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(statistics([t or "" for t in texts])) >= threshold)

    return docs.where(good(F.col("text")))

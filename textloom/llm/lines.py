"""Line dedup by a deletion-neighbourhood join.

A line is what stands between newlines, if it has a word. Two lines are the same if their words are (A-Z
lower-cased, white space aside). Two lines are near if at most ``edits`` insertions, deletions or
replacements of a unit make them the same. The unit is the word for lines of at least ``near_words`` words,
and the character (of the lower-cased words, one space apart) for shorter lines of at least ``near_chars``
characters: one edit in less leaves no likeness. Lines of different units are not near. The order is
doc_id (nulls last), then the text's hash, then line number. A line is dropped if an earlier line is the
same or near; the earliest stays.

1. ``line_rows``: hashes of every line, and of its first and last units.
2. The first line of each hash. One edit leaves the first or the last half of a line as it is, so lines
   that share neither with another line have no near line; only the others go on. (With more edits than
   one, all go on.)
3. Each of those emits its deletion neighbourhood as hashed keys: all variants with up to ``edits`` units
   taken out or marked at their place. Two lines are near exactly if they have an equal key with as many
   marks, and marks and deletions of both sides together are no more than ``edits``; so equal keys are
   joined by the smallest line of each kind per key, never by pairs of a key's lines.
4. Edit distance verifies each line against the earliest line it was joined with.

Defined cases: null or empty texts have no lines; a very long line is one line; equal rows are one
document; rows with one doc_id, or none, are told apart by a hash of doc_id and text and come in the order
of these hashes; an empty table gives no rows. ``dedup`` returns all columns, drops lines from text, and
drops a document only if it had lines and none is left. Lines are told apart by 96 bits of hash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, join_by_weight, slices, unused
from textloom.llm.words import mixed, word_hashes

NEAR_WORDS, NEAR_CHARS, EDITS = 8, 20, 1
LAST = (1 << 63) - 1
BLANKS = "[ \\t\\n\\x0b\\f\\r]"
#: Bases of the polynomial hashes of sequences, and the first one's inverse modulo 2^64.
BASE, SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
INVERSE = pow(BASE, -1, 1 << 64)
#: Sets characters apart from words.
CHARACTER = np.uint64(0xD6E8FEB86659FD93)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def halves(words: np.ndarray) -> np.ndarray:
    """Largest power of two that is at most half of each count."""
    return np.left_shift(1, np.maximum(0, np.frexp(np.maximum(words, 2) / 2)[1] - 1))


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    found = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), pattern="\n")
    places = found.offsets.to_numpy().astype(np.int64)
    return found.flatten(), places - places[0]


def plain(lines: pa.Array) -> pa.Array:
    """Lines with A-Z lower-cased and one space between words."""
    return pc.ascii_trim(pc.replace_substring_regex(pc.ascii_lower(lines.cast(pa.large_string())), pattern=BLANKS + "+", replacement=" "), " ")


def units(lines: pa.Array, words: np.ndarray, bounds: np.ndarray, near_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the units of all lines one behind the other, and where lines begin and end: the words given
    for lines of at least near_words, else characters."""
    counts = np.diff(bounds)
    short = np.flatnonzero((counts < near_words) & (counts > 0))
    if not len(short):
        return words, bounds
    texts = plain(lines.take(pa.array(short)))
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = counts.copy()
    sizes[short] = pc.utf8_length(texts).to_numpy()
    places = np.concatenate([[0], np.cumsum(sizes)])
    by_char = np.repeat((counts < near_words), sizes)
    out = np.empty(places[-1], dtype=np.uint64)
    out[by_char] = mixed(codes + CHARACTER)
    out[~by_char] = words[np.repeat(counts >= near_words, counts)]
    return out, places


def hashed(lines: pa.Array, near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words, 64 and 32 bits of hash, and up to four half keys (0: none) of each line."""
    words, bounds = word_hashes(lines)
    counts = np.diff(bounds)

    def summed(bounds: np.ndarray):
        """Places from the front and the back, and sums by line, of a sequence with these bounds."""
        sizes = np.diff(bounds)
        line = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(bounds[-1]) - bounds[:-1][line]

        def total(values: np.ndarray, mask=None) -> np.ndarray:
            if mask is not None:
                values = np.where(mask, values, np.uint64(0))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
            return sums[bounds[1:]] - sums[bounds[:-1]]

        return line, at, sizes[line] - 1 - at, total

    _, at, _, total = summed(bounds)
    longest = int(counts.max(initial=1)) + 1
    one = mixed(total(words * powers(BASE, longest)[at]) + counts.astype(np.uint64))
    two = mixed(total(words * powers(SECOND, longest)[at])) >> np.uint64(33)
    values, bounds = units(lines, words, bounds, near_words)
    sizes = np.diff(bounds)
    least = np.where(counts >= near_words, near_words, near_chars)
    line, at, back, total = summed(bounds)
    forth = powers(BASE, int(sizes.max(initial=1)) + 1)
    ahead, behind = values * forth[at], values * forth[back]
    keys = []
    half = halves(sizes)
    exact = (sizes & (sizes - 1)) == 0  # such lines also meet those with a unit less
    for h, valid in ((half, sizes >= least), (half // 2, (sizes > least) & exact)):
        size = mixed(h.astype(np.uint64))
        for salt, own, place in ((1, ahead, at), (2, behind, back)):
            keys.append(np.where(valid, mixed(total(own, place < h[line]) + size * np.uint64(salt)) | np.uint64(1), np.uint64(0)))
    return counts, one, two, keys


ROWS = "doc_id long, row long, line int, h1 long, h2 int, k1 long, k2 long, k3 long, k4 long"


def _ord() -> F.Column:
    """doc_id, nulls last."""
    return F.coalesce("doc_id", F.lit(LAST)).alias("ord")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of doc_id and text), text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def line_rows(docs: DataFrame, near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS) -> DataFrame:
    """A row for each line with a word, of documents (doc_id, row, text)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                lines, places = split_lines(part.column("text"))
                counts, one, two, keys = hashed(lines, near_words, near_chars)
                doc = np.repeat(np.arange(part.num_rows), np.diff(places))
                number = np.arange(len(lines)) - places[:-1][doc]
                kept = np.flatnonzero(counts > 0)
                at = pa.array(doc[kept])
                columns = [part.column("doc_id").take(at), part.column("row").take(at), pa.array(number[kept].astype(np.int32)), pa.array(one[kept].view(np.int64)), pa.array(two[kept].astype(np.int32))]
                columns += [pa.array(k[kept].view(np.int64), mask=k[kept] == 0) for k in keys]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "line", "h1", "h2", "k1", "k2", "k3", "k4"])

    return docs.select("doc_id", "row", "text").mapInArrow(run, ROWS)


VARIANTS = "key long, marks tinyint, gone tinyint, rank long"


def variants(values: np.ndarray, edits: int) -> dict[int, tuple[int, int]]:
    """Keys of all variants of a sequence with up to `edits` units marked or taken out: {key: (marks, gone)}."""
    out: dict[int, tuple[int, int]] = {}
    own, n = values.tolist(), len(values)
    for changes in range(min(edits, n) + 1):
        for places in combinations(range(n), changes):
            for marked in range(1 << changes):
                sequence, at = list(own), 0
                for bit in range(changes - 1, -1, -1):
                    if marked >> bit & 1:
                        sequence[places[bit]] = 0
                    else:
                        del sequence[places[bit]]
                for v in sequence:  # polynomial in the order of units; a mark is a unit of its own
                    at = (at * BASE + v + 1) % (1 << 64)
                marks = marked.bit_count()
                key = int(mixed(np.array([at + len(sequence) + (marks << 32)], dtype=np.uint64))[0])
                out.setdefault(key, (marks, changes - marks))
    return out


def neighbourhood(lines: DataFrame, near_words: int = NEAR_WORDS, edits: int = EDITS) -> DataFrame:
    """key, marks (units marked at their place), gone (units taken out), rank of each line's variants.

    shared says which half keys the line shares with another (bits 0, 2: first units; 1, 3: last ones);
    a single edit then lies behind the shared first units or before the shared last ones.
    """

    def of_one(batch, values, bounds):
        counts = np.diff(bounds)
        line = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(values)) - bounds[:-1][line]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(BASE, int(counts.max(initial=1)))[at], dtype=np.uint64)])
        total = sums[bounds[1:]] - sums[bounds[:-1]]
        ahead, behind = sums[:-1] - sums[bounds[:-1]][line], sums[bounds[1:]][line] - sums[1:]
        less = mixed(ahead + behind * np.uint64(INVERSE) + (counts[line] - 1).astype(np.uint64))
        placed = mixed(less + mixed(at.astype(np.uint64) + np.uint64(1)))
        shared, half = batch.column("shared").to_numpy()[line], halves(counts)[line]
        back = counts[line] - 1 - at
        kept = np.zeros(len(values), dtype=bool)
        for bit, place, least in ((1, at, half), (2, back, half), (4, at, half // 2), (8, back, half // 2)):
            kept |= (shared & bit > 0) & (place >= least)
        rank = batch.column("rank").to_numpy()
        own = rank[line][kept]
        key = np.concatenate([mixed(total + counts.astype(np.uint64)), less[kept], placed[kept]]).view(np.int64)
        sizes = [len(rank), len(own), len(own)]
        return key, np.repeat(np.array([0, 0, 1], np.int8), sizes), np.repeat(np.array([0, 1, 0], np.int8), sizes), np.concatenate([rank, own, own])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words, bounds = word_hashes(batch.column("text"))
            values, bounds = units(batch.column("text"), words, bounds, near_words)
            if edits == 1:
                columns = of_one(batch, values, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "marks", "gone", "rank"])
                continue
            for rank, a, b in zip(batch.column("rank").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                own = variants(values[a:b], edits)
                key = np.fromiter(own, dtype=np.uint64, count=len(own)).view(np.int64)
                kinds = np.array(list(own.values()), dtype=np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kinds[:, 0]), pa.array(kinds[:, 1]), pa.array(np.full(len(own), rank))], names=["key", "marks", "gone", "rank"])

    return lines.select("rank", "shared", "text").mapInArrow(run, VARIANTS)


def within(a, b, edits: int = 1) -> bool:
    """Whether at most `edits` insertions, deletions or replacements turn sequence a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    if edits == 1:
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[k + (len(a) == len(b)) :] == b[k + 1 :]
    far = edits + 1
    row = {j: j for j in range(min(len(b), edits) + 1)}
    for i, x in enumerate(a, 1):
        last, row = row, {}
        for j in range(max(0, i - edits), min(len(b), i + edits) + 1):
            row[j] = min(last.get(j, far) + 1, row.get(j - 1, far) + 1, last.get(j - 1, far) + (x != b[j - 1]) if j else far)
    return row[len(b)] <= edits


def near_lines(docs: DataFrame, firsts: DataFrame, near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS, edits: int = EDITS) -> DataFrame:
    """h1, h2 of first lines that an earlier first line is near to, and that line's ord."""
    mark = ["h1", "h2"]
    keys = firsts.select(*mark, F.posexplode(F.array("k1", "k2", "k3", "k4")).alias("place", "half")).where("half is not null")
    if edits > 1:  # every line of a length that counts
        open_ = keys.select(*mark, F.lit(15).alias("shared")).distinct()
    else:
        again = keys.groupBy("half").count().where("count > 1").select("half")
        open_ = keys.join(again, "half", "left_semi").groupBy(*mark).agg(F.expr("bit_or(shiftleft(1, place))").alias("shared"))
    wanted = firsts.join(open_, mark).select("ord", "row", "line", *mark, "shared")
    # the lines of a document that are wanted: never more than its own lines
    per_doc = wanted.groupBy("ord", "row").agg(F.collect_list(F.struct("line", *mark, "shared")).alias("lines"))
    texts = docs.select(_ord(), "row", F.split("text", "\n").alias("all"))
    picked = texts.join(per_doc, ["ord", "row"]).select("ord", "row", "all", F.explode("lines").alias("at"))
    picked = picked.select("ord", "row", "at.line", "at.h1", "at.h2", "at.shared", F.element_at("all", F.col("at.line") + 1).alias("text"))
    picked = cut(picked.dropDuplicates(mark), "picked")  # equal rows would bring a line twice
    # dealt by range and numbered in order: rank compares as (ord, row, line) does, in one long
    order = ["ord", "row", "line"]
    in_order = picked.repartitionByRange(*order).sortWithinPartitions(*order)
    lines = cut(in_order.withColumn("rank", F.monotonically_increasing_id()), "lines")
    every = neighbourhood(lines, near_words, edits)
    least = [F.min(F.when(F.col("gone") == k, F.col("rank"))).alias(f"least{k}") for k in range(edits + 1)]
    groups = every.groupBy("key", "marks").agg(F.count(F.lit(1)).alias("rows"), *least).where("rows > 1").drop("rows")
    changed = F.col("marks") + F.col("gone")
    reach = [F.when(changed + k <= edits, F.col(f"least{k}")) for k in range(edits + 1)]
    joined = every.join(groups, ["key", "marks"]).withColumn("other", F.least(*reach)).where(F.col("other") < F.col("rank"))
    earliest = joined.groupBy("rank").agg(F.min("other").alias("other"))
    pairs = earliest.join(lines.select("rank", *mark, "text"), "rank")
    pairs = pairs.join(lines.select(F.col("rank").alias("other"), F.col("ord").alias("earlier"), F.col("text").alias("other_text")), "other")

    @F.pandas_udf("boolean")
    def verified(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right):
            words = [x.encode().lower().split() for x in (a, b)]
            if all(len(w) < near_words for w in words):
                words = [b" ".join(w).decode() for w in words]
            out.append(within(*words, edits))
        return pd.Series(out, dtype=bool)

    return pairs.where(verified("text", "other_text")).groupBy(*mark).agg(F.min("earlier").alias("earlier"))


def dropped_lines(docs: DataFrame, near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS, edits: int = EDITS) -> DataFrame:
    """doc_id, row, line of the lines to drop, with the doc_id of the earlier line; docs as ``keyed`` gives them."""
    rows = cut(line_rows(docs, near_words, near_chars), "line-rows")
    place = F.struct(_ord(), "row", "line")
    firsts = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), *[F.min(k).alias(k) for k in ("k1", "k2", "k3", "k4")])
    firsts = cut(firsts.select("h1", "h2", "first.*", "n", "k1", "k2", "k3", "k4"), "firsts")
    near = near_lines(docs, firsts, near_words, near_chars, edits)
    told = firsts.select("h1", "h2", "n", F.struct("ord", "row", "line").alias("first")).join(near, ["h1", "h2"], "left")
    told = cut(told.where("n > 1 or earlier is not null"), "told")
    # a line that very many documents have stays where it is
    joined = join_by_weight(rows.select("doc_id", "row", "line", "h1", "h2"), told, ["h1", "h2"], "n", rows.count())
    gone = joined.where(F.col("earlier").isNotNull() | (place != F.col("first")))
    earlier = F.coalesce("earlier", "first.ord")
    return gone.select("doc_id", "row", "line", F.when(earlier != LAST, earlier).alias("earlier"))


def decisions(docs: DataFrame, near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS, edits: int = EDITS) -> DataFrame:
    """One row per doc_id: doc_id, n_lines, n_dropped, dropped, earlier.

    dropped lists line numbers, earlier the doc_ids in which a line stood before, both as joined strings.
    Rows that share a doc_id are counted together, equal rows once.
    """
    docs = keyed(docs)
    gone = dropped_lines(docs, near_words, near_chars, edits)
    per_doc = gone.groupBy(F.col("doc_id").alias("_b")).agg(
        F.sort_array(F.collect_set("line")).alias("lines"), F.sort_array(F.collect_set("earlier")).alias("docs"), F.count_distinct("row", "line").alias("n_dropped")
    )
    has_word = lambda x: x.rlike("[^ \\t\\n\\x0b\\f\\r]")
    lines = docs.select("doc_id", "row", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), has_word)).alias("n"))
    counts = lines.groupBy("doc_id", "row").agg(F.max("n").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n_lines"))
    return counts.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_b")), "left").select(
        "doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join("lines", ","), F.lit("")).alias("dropped"), F.coalesce(F.array_join("docs", ","), F.lit("")).alias("earlier"),
    )


def dedup(docs: DataFrame, near_words: int = NEAR_WORDS, near_chars: int = NEAR_CHARS, edits: int = EDITS) -> DataFrame:
    """The documents with repeated lines taken out of text; n_chars, where there is one, follows."""
    gone = dropped_lines(keyed(docs), near_words, near_chars, edits)
    of, row, own, marks, fresh = (unused(docs, x) for x in ("of", "row", "own", "marks", "fresh"))
    per_doc = gone.groupBy(_ord().alias(of), F.col("row").alias(row)).agg(F.collect_set("line").alias(marks))

    @F.pandas_udf("string")
    def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for text, lines in zip(texts, gone):
            drop = set() if lines is None else set(lines.tolist())
            kept = [x for n, x in enumerate((text or "").split("\n")) if n not in drop]
            out.append("\n".join(kept) if any(x.strip(" \t\n\x0b\f\r") for x in kept) else None)
        return pd.Series(out, dtype=object)

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    joined = docs.withColumn(own, F.xxhash64(doc_id, text))
    joined = joined.join(per_doc, (F.coalesce(doc_id, F.lit(LAST)) == F.col(of)) & (F.col(own) == F.col(row)), "left")
    touched = F.col(marks).isNotNull()
    joined = joined.withColumn(fresh, F.when(touched, without(F.when(touched, text), F.col(marks))).otherwise(text))
    joined = joined.where(~touched | F.col(fresh).isNotNull())
    values = {"text": F.col(fresh)}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(touched, F.length(fresh)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])

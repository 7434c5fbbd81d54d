"""N-gram Jaccard join by signature trees: exact links, one row per document.

1. ``digest``: each text's shingle set, its class (texts with one set share it), a bit signature of at least its size,
   and shingles that are frequent within a batch.
2. ``groups``: two sets that link share one of the first n - ceil(3n/4) + 1 shingles of each in any
   common order. The order puts frequent shingles last (it changes cost, never the result). Classes
   that share such a shingle form a group.
3. ``candidates``: over each group a signature tree: nodes hold the OR and AND of signatures and the
   range of set sizes; a dual traversal drops node pairs whose largest possible overlap is too small,
   and pairs that are connected already. What is left spans the candidate clusters.
4. ``links``: each cluster's sets meet in one task (large clusters are dealt out in pairs of blocks),
   where the same traversal verifies pairs exactly.
5. Components of the links; every document gets the smallest doc_id of its component.

Copies are never expanded: all of a text's copies are one class.

Defined cases: null or wordless texts have n_shingles 0 and are alone; equal rows are equal classes;
a null doc_id takes part, and is the component_id only where no other is in the component; rows are told
apart by a hash of doc_id and text, so rows with one doc_id may have different sets, and ``keep_one`` keeps
one row of a component even if several have its smallest doc_id or none has one (all rows without words
stay); an empty table gives no rows. Texts of any length are taken whole. Classes are 64-bit hashes of sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, input_bytes, join_by_weight, partitions_for, slices, unused
from textloom.llm.components import components
from textloom.llm.words import mixed, shingle_sets

#: Bits of a signature: a power of two, this at least and no less than the set's size.
BITS = 1024
FANOUT = 16
#: Frequent shingles: share of documents from which on they go last, and how many of them at most.
FREQUENT_SHARE, FREQUENT_MOST = 0.001, 100_000
#: Shingles of a cluster that one task takes; larger clusters are dealt out in pairs of blocks.
CLUSTER_SHINGLES = 1 << 20

DIGEST = "doc_id long, row long, class long, n int, signature binary"
LAST = (1 << 63) - 1


def signature(own: np.ndarray) -> bytes:
    width = max(BITS, 1 << (len(own) - 1).bit_length())
    bits = np.zeros(width, dtype=np.uint8)
    bits[(own & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(mark: bytes, size: int) -> np.ndarray:
    """A signature at a smaller power of two of bytes: the same as if it had been made so."""
    return np.bitwise_or.reduce(np.frombuffer(mark, "<u8").reshape(-1, size // 8), axis=0)


def class_of(own: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) if len(own) else None


def digest(docs: DataFrame) -> DataFrame:
    """A row per document; rows with n = -1 list frequent shingles of one batch and their counts."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                sets = shingle_sets(part.column("text"))
                classes = [class_of(s) for s in sets]
                ids, own = part.column("doc_id").to_pylist(), part.column("row").to_pylist()
                sizes, marks = [len(s) for s in sets], [signature(s) if len(s) else None for s in sets]
                once = {c: s for c, s in zip(classes, sets) if c is not None}
                if once:
                    every = np.sort(np.concatenate(list(once.values())))
                    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
                    counts = np.diff(np.append(first, len(every)))
                    often = np.flatnonzero(counts >= max(3, FREQUENT_SHARE * len(once)))
                    often = often[np.argsort(-counts[often], kind="stable")[: 1 << 14]]
                    ids.append(None)
                    own.append(None)
                    classes.append(None)
                    sizes.append(-1)
                    marks.append(every[first[often]].astype("<u8").tobytes() + counts[often].astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(own, pa.int64()), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(marks, pa.binary())],
                    names=["doc_id", "row", "class", "n", "signature"],
                )

    return docs.select("doc_id", "row", "text").mapInArrow(run, DIGEST)


def frequent(digests: DataFrame, n_docs: int) -> np.ndarray:
    """Shingles that go last, rarer ones first: at most FREQUENT_MOST, whatever the corpus."""

    def unpack(batches):
        for batch in batches:
            raw = [np.frombuffer(x.as_py(), "<u8") for x in batch.column(0)]
            keys = [r[: len(r) // 2].view(np.int64) for r in raw]
            counts = [r[len(r) // 2 :].view(np.int64) for r in raw]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (keys, counts)], names=["key", "count"])

    rows = digests.where("n = -1").select("signature").mapInArrow(unpack, "key long, count long").groupBy("key").agg(F.sum("count").alias("count"))
    rows = rows.where(F.col("count") >= max(16, int(FREQUENT_SHARE * n_docs))).orderBy(F.desc("count"), "key").limit(FREQUENT_MOST)
    return np.array([r["key"] for r in rows.collect()][::-1], dtype=np.int64).view(np.uint64)


def prefix(own: np.ndarray, last: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(3n/4) + 1 shingles; last is sorted, rank its places in the order."""
    n = len(own)
    if len(last):
        at = np.minimum(np.searchsorted(last, own), len(last) - 1)
        late = last[at] == own
        if late.any():
            own = np.concatenate([own[~late], own[late][np.argsort(rank[at[late]])]])
    return own[: n - (3 * n + 3) // 4 + 1]


def groups(docs: DataFrame, order: np.ndarray, parts: int) -> DataFrame:
    """(gid, class): sets of classes that share a shingle of their prefixes."""
    sort = np.argsort(order)
    last, rank = order[sort], sort

    def emit(batches):
        seen = set()
        for batch in batches:
            for piece in slices(batch):
                keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for own in shingle_sets(piece.column("text")):
                    c = class_of(own)
                    if c is None or c in seen:
                        continue
                    seen.add(c)
                    keys.append(prefix(own, last, rank))
                    owners.append(np.full(len(keys[-1]), c))
                key, owner = np.concatenate(keys), np.concatenate(owners)
                part = (key % np.uint64(parts)).astype(np.int32)
                by = np.argsort(part, kind="stable")
                key, owner, part = (key[by] >> np.uint64(32)).astype("<u4"), owner[by], part[by]
                edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
                rows = [[], [], [], []]
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)]):
                    first = np.flatnonzero(np.concatenate([[True], owner[a + 1 : b] != owner[a : b - 1]]))
                    for col, x in zip(rows, (int(part[a]), key[a:b].tobytes(), owner[a:b][first].tobytes(), np.diff(np.append(first, b - a)).astype("<u4").tobytes())):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "keys", "owners", "counts"])

    def gather(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("keys")])
        owners = np.concatenate([np.repeat(np.frombuffer(o.as_py(), "<i8"), np.frombuffer(c.as_py(), "<u4")) for o, c in zip(table.column("owners"), table.column("counts"))])
        by = np.lexsort((owners, keys))
        keys, owners = keys[by], owners[by]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])])
        keys, owners = keys[new], owners[new]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.append(first, len(keys)))
        gid = np.add.reduceat(mixed(owners.view(np.uint64)), first) + count.astype(np.uint64)
        many = np.flatnonzero(count > 1)
        many = many[np.unique(gid[many], return_index=True)[1]]  # equal groups once
        at = np.repeat(first[many] - np.cumsum(count[many]) + count[many], count[many]) + np.arange(count[many].sum())
        return pa.table({"gid": pa.array(np.repeat(gid[many].view(np.int64), count[many])), "class": pa.array(owners[at])})

    blocks = docs.select("text").mapInArrow(emit, "part int, keys binary, owners binary, counts binary")
    return blocks.groupBy("part").applyInArrow(gather, "gid long, class long")


class SignatureTree:
    """Leaves in order of set size; each level above joins FANOUT nodes: OR, AND, size range."""

    def __init__(self, sizes: np.ndarray, marks: np.ndarray) -> None:
        self.order = np.lexsort((marks[:, 0], sizes))
        leaf = marks[self.order], marks[self.order], sizes[self.order], sizes[self.order]
        self.levels = [leaf]
        while len(self.levels[-1][2]) > 1 or len(self.levels) == 1:
            some, every, low, high = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(some, at), np.bitwise_and.reduceat(every, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which node pairs may hold a link: sizes within 3/4, and enough overlap possible."""
        some, every, low, high = self.levels[level]
        apart = (np.bitwise_count(every[a] & ~some[b]) + np.bitwise_count(every[b] & ~some[a])).sum(axis=1, dtype=np.int64)
        # a link's sets differ in at most a seventh of their summed sizes
        return (4 * high[a] >= 3 * low[b]) & (4 * high[b] >= 3 * low[a]) & (7 * apart <= high[a] + high[b])

    def spanning(self, verify=None) -> list[tuple[int, int]]:
        """Pairs that connect whatever the possible (and verified) pairs connect."""
        n = len(self.order)
        label, found = np.arange(n), []
        members: dict[int, list[int]] = {}
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            width = FANOUT**level
            left, right = label[i * width : (i + 1) * width], label[j * width : (j + 1) * width]
            if (left == left[0]).all() and (right == left[0]).all():
                continue
            below = len(self.levels[level - 1][2])
            x = np.arange(i * FANOUT, min((i + 1) * FANOUT, below))
            y = np.arange(j * FANOUT, min((j + 1) * FANOUT, below))
            a, b = np.repeat(x, len(y)), np.tile(y, len(x))
            if i == j:
                keep = a < b if level == 1 else a <= b
                a, b = a[keep], b[keep]
            keep = self.possible(level - 1, a, b)
            pairs = zip(a[keep].tolist(), b[keep].tolist())
            if level > 1:
                # neighbours in size first: they are popped first and connect most
                stack += sorted(((level - 1, p, q) for p, q in pairs), key=lambda t: t[1] - t[2])
                continue
            for p, q in pairs:
                if label[p] != label[q] and (verify is None or verify(self.order[p], self.order[q])):
                    found.append((int(self.order[p]), int(self.order[q])))
                    # the smaller side takes the other's label: each leaf changes at most log2(n) times
                    small, big = sorted((int(label[p]), int(label[q])), key=lambda x: len(members.get(x, (x,))))
                    moved = members.pop(small, [small])
                    members.setdefault(big, [big]).extend(moved)
                    label[moved] = big
        return found


def spanning(sizes: np.ndarray, marks: list[bytes], verify=None) -> list[tuple[int, int]]:
    """Spanning pairs of sets whose signatures differ in width.

    A link's sizes are within 4/3 of each other, so its widths are equal or one is twice the other:
    a tree for each width takes its own sets and, folded, those of twice the width that are near.
    """
    widths, out = np.fromiter(map(len, marks), dtype=np.int64, count=len(marks)), []
    for width in np.unique(widths).tolist():
        own = widths == width
        at = np.flatnonzero(own | (widths == 2 * width) & (3 * sizes <= 4 * sizes[own].max()))
        if len(at) > 1:
            tree = SignatureTree(sizes[at], np.stack([folded(marks[k], width) for k in at.tolist()]))
            out += [(int(at[p]), int(at[q])) for p, q in tree.spanning(verify and (lambda p, q: verify(at[p], at[q])))]
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, of ascending distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


def _edges(pairs: set[tuple[int, int]]) -> pa.Table:
    flat = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(flat[:, 0]), "b": pa.array(flat[:, 1])})


def candidates(grouped: DataFrame, classes: DataFrame, slots: int) -> DataFrame:
    """Edges (a, b) that span, within each group, what the signature trees can't rule out."""

    def span(table: pa.Table) -> pa.Table:
        gid, owner, n = (table.column(c).to_numpy() for c in ("gid", "class", "n"))
        marks = table.column("signature").to_pylist()
        by = np.lexsort((owner, gid))
        by = by[np.concatenate([[True], (gid[by][1:] != gid[by][:-1]) | (owner[by][1:] != owner[by][:-1])])]
        gid, owner, n, marks = gid[by], owner[by], n[by].astype(np.int64), [marks[k] for k in by.tolist()]
        first = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
        count = np.diff(np.append(first, len(gid)))
        # most groups are pairs of sets of ordinary size: all of them at once
        plain = (count == 2) & (np.maximum(n[first], n[np.minimum(first + 1, len(n) - 1)]) <= BITS)
        two = first[plain]
        left, right = (np.frombuffer(b"".join(marks[k] for k in at.tolist()), "<u8").reshape(-1, BITS // 64) for at in (two, two + 1))
        apart = np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)
        n1, n2 = n[two], n[two + 1]
        two = two[(7 * apart <= n1 + n2) & (4 * n1 >= 3 * n2) & (4 * n2 >= 3 * n1)]
        pairs = set(zip(owner[two].tolist(), owner[two + 1].tolist()))
        for a, c in zip(first[~plain].tolist(), count[~plain].tolist()):
            pairs.update((int(owner[a + p]), int(owner[a + q])) for p, q in spanning(n[a : a + c], marks[a : a + c]))
        return _edges(pairs)

    rows = grouped.join(classes.select("class", "n", "signature"), "class").withColumn("slot", F.pmod(F.col("gid"), F.lit(slots)).cast("int"))
    return rows.select("slot", "gid", "class", "n", "signature").groupBy("slot").applyInArrow(span, "a long, b long")


def links(docs: DataFrame, members: DataFrame, slots: int) -> DataFrame:
    """Verified edges (a, b) within clusters; members: class, cluster, n, ord and row (any row of the class)."""
    weight = members.groupBy("cluster").agg(F.sum("n").alias("weight")).select("cluster", F.ceil(F.col("weight") / CLUSTER_SHINGLES).cast("int").alias("blocks"))
    dealt = members.join(weight, "cluster").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    # a block meets every block: its rows go to as many tasks as the cluster has blocks
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("ord", "row", "class", "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = dealt.withColumn("slot", F.pmod(F.xxhash64("cluster", "i", "j"), F.lit(slots)).cast("int"))
    texts = docs.select("ord", "row", "text").join(dealt, ["ord", "row"])

    def verify(table: pa.Table) -> pa.Table:
        sets = [own for batch in table.to_batches() for piece in slices(batch) for own in shingle_sets(piece.column("text"))]
        owner = table.column("class").to_numpy()
        keys = list(zip(*(table.column(c).to_pylist() for c in ("cluster", "i", "j"))))
        tasks: dict = {}
        for k, (key, c, own) in enumerate(zip(keys, owner.tolist(), sets)):
            if class_of(own) == c:
                tasks.setdefault(key, {})[c] = k
        pairs = set()
        for rows in tasks.values():
            at = list(rows.values())
            if len(at) > 1:
                sizes = np.array([len(sets[k]) for k in at], dtype=np.int64)
                found = spanning(sizes, [signature(sets[k]) for k in at], lambda p, q: linked(sets[at[p]], sets[at[q]]))
                pairs.update((int(owner[at[p]]), int(owner[at[q]])) for p, q in found)
        return _edges(pairs)

    return texts.select("slot", "cluster", "i", "j", "class", "text").groupBy("slot").applyInArrow(verify, "a long, b long")


def _ord() -> F.Column:
    """doc_id, nulls last."""
    return F.coalesce("doc_id", F.lit(LAST)).alias("ord")


def solved(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Rows (doc_id, row, class, n) and their number's table of classes (class, copies, ord, row of the
    component's first document), the first documents (ord, row), and whether there are equal rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", _ord(), F.xxhash64("doc_id", "text").alias("row"), "text")
    spark = docs.sparkSession
    parts = 2 * partitions_for(spark, 2 * input_bytes(docs), 16 << 20)
    digests = cut(digest(docs), "digests")
    rows = digests.where("n >= 0")
    order = frequent(digests, rows.count())
    grouped = cut(groups(docs, order, parts), "groups")
    first = F.min(F.struct(_ord(), "row")).alias("first")
    classes = rows.where("n > 0").groupBy("class").agg(F.min("n").alias("n"), F.min("signature").alias("signature"), first, F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.select("class", "n", "signature", "first", "copies"), "classes")
    equal = not rows.groupBy(_ord(), "row").count().where("count > 1").isEmpty()
    near = components(candidates(grouped, classes, parts))
    near = near.select(F.col("node").alias("class"), F.col("root").alias("cluster")).union(near.select("root", "root").distinct())
    members = near.join(classes.select("class", "n", "first.ord", "first.row"), "class")
    one_each = docs.dropDuplicates(["ord", "row"]) if equal else docs
    final = components(links(one_each, members, parts)).select(F.col("node").alias("class"), "root")
    named = cut(classes.select("class", "first", "copies").join(final, "class", "left").withColumn("root", F.coalesce("root", "class")), "named")
    least = cut(named.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("members")), "least")
    known = join_by_weight(named.select("class", "copies", "root"), least, ["root"], "members", named.count())
    known = cut(known.select("class", "copies", "least.ord", F.col("least.row").alias("of")), "known")
    return rows.select("doc_id", "row", "class", "n"), known, least.select("least.ord", "least.row"), equal


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows, known, _, _ = solved(docs)
    worded = join_by_weight(rows.where("n > 0"), known.select("class", "copies", "ord"), ["class"], "copies", rows.count())
    worded = worded.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("ord") != LAST, F.col("ord")).alias("component_id"))
    return worded.unionByName(rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the first by doc_id (nulls last) and a hash of the text, with all its
    columns; documents without words stay."""
    rows, _, least, equal = solved(docs)
    of, row = unused(docs, "of"), unused(docs, "row")
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.withColumn(of, F.coalesce(doc_id, F.lit(LAST))).withColumn(row, F.xxhash64(doc_id, F.col("text").cast("string")))
    wordless = rows.where("n = 0").select(_ord(), "row").distinct()
    named = lambda df: df.select(F.col("ord").alias(of), F.col("row").alias(row))
    if not equal:
        return keyed.join(named(least.union(wordless)), [of, row], "left_semi").select(*docs.columns)
    # equal rows: one of each that has words
    first = keyed.join(named(least), [of, row], "left_semi").dropDuplicates([of, row])
    return first.unionByName(keyed.join(named(wordless), [of, row], "left_semi")).select(*[F.col(f"`{c}`") for c in docs.columns])

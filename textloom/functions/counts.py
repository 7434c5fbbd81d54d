"""Words counted by document, over Arrow batches of documents in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textloom.functions.stem import stem

#: Text that a worker takes at a time. Array code needs some thirty times this while it works.
BATCH_BYTES = 4 << 20
#: Entries in a row; a document with more has several rows.
ROW_ENTRIES = 1 << 16


def _sizes(batch: pa.RecordBatch) -> np.ndarray:
    """About how many bytes each row has."""
    words = batch.column("words")
    if pa.types.is_list(words.type):
        return pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False) * 8
    return pc.binary_length(words).fill_null(0).to_numpy(zero_copy_only=False)


def _numbers(docs: pa.Array) -> np.ndarray:
    """Equal documents, which lie together, have equal numbers, counted from 0."""
    codes = docs.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(np.diff(codes) != 0)])


def whole_documents(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows (doc, words) of about `limit` bytes that have all rows of their documents; they come in order of doc."""
    held, size = [], 0
    for batch in batches:
        sizes = _sizes(batch)
        edges = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            held.append(batch.slice(a, b - a))
            size += int(sizes[a:b].sum())
            last = held[-1].column("doc")[-1]
            if size < limit or held[0].column("doc")[0] == last:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            number = _numbers(rows.column("doc"))
            cut = int(np.searchsorted(number, number[-1]))
            yield rows.slice(0, cut)
            held = [rows.slice(cut)]
            size = int(_sizes(held[0]).sum())
            pa.default_memory_pool().release_unused()
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Counts:
    """Places of each term in each document of a batch (doc, words: a text cut at single spaces, or an array of words).

    Words of a text without a character beyond the space, and nulls of an array, keep their place but are no terms.
    With stems, a word's places count under its stem as well, where that differs.
    """

    def __init__(self, rows: pa.RecordBatch, stems: bool) -> None:
        words, self.docs = rows.column("words"), rows.column("doc")
        text = not pa.types.is_list(words.type)
        if text:
            words = pc.split_pattern(words, " ")
        lengths = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 1
        coded = pc.list_flatten(words).dictionary_encode()
        terms = coded.dictionary
        code = coded.indices.fill_null(len(terms)).to_numpy(zero_copy_only=False).astype(np.int64)
        is_term = np.ones(len(terms) + 1, dtype=bool)
        is_term[-1] = False
        if text:
            is_term[:-1] = pc.match_substring_regex(terms, r"[^\x00-\x20]").to_numpy(zero_copy_only=False)
        kept = is_term[code]
        number = _numbers(self.docs) if len(self.docs) else np.zeros(0, dtype=np.int64)
        self.first = np.flatnonzero(np.concatenate([[True], np.diff(number) != 0])) if len(number) else number
        doc, code, at = number[row[kept]], code[kept], at[kept]
        if stems and len(terms):
            roots = pa.array([stem(w) if k else w for w, k in zip(terms.to_pylist(), is_term[:-1].tolist())], type=terms.type)
            both = pa.concat_arrays([terms, roots]).dictionary_encode()
            root = both.indices.to_numpy()[len(terms) :][code]
            differs = root != code  # distinct terms keep their codes
            terms = both.dictionary
            doc, code, at = np.concatenate([doc, doc[differs]]), np.concatenate([code, root[differs]]), np.concatenate([at, at[differs]])
        self.terms = terms
        # by document, term, place: one number where it has room
        places, n_terms = int(at.max(initial=0)) + 1, len(terms) + 1
        if len(self.first) * n_terms * places < 1 << 63:
            key = (doc * n_terms + code) * places + at
            key.sort()
            key, at = np.divmod(key, places)
            doc, code = np.divmod(key, n_terms)
        else:
            order = np.lexsort((at, code, doc))
            doc, code, at = doc[order], code[order], at[order]
        new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(code) != 0)]) if len(doc) else np.zeros(0, dtype=bool)
        self.starts = np.append(np.flatnonzero(new), len(doc))
        self.at, self.doc, self.code, self.tf = at, doc[new], code[new], np.diff(self.starts)

    def documents(self, only: list[str] | None) -> Iterator[pa.RecordBatch]:
        """doc, l2, entries (term, tf, positions): those of the terms in `only`, where given."""
        squares = np.bincount(self.doc, weights=self.tf.astype(np.float64) ** 2, minlength=len(self.first))
        doc, code, tf, starts, at = self.doc, self.code, self.tf, self.starts, self.at
        if only is not None:
            wanted = pc.is_in(self.terms, value_set=pa.array(only, type=self.terms.type)).to_numpy(zero_copy_only=False)[code]
            at, doc, code, tf = at[np.repeat(wanted, tf)], doc[wanted], code[wanted], tf[wanted]
            starts = np.concatenate([[0], np.cumsum(tf)])
        if not len(doc):
            return
        row = np.flatnonzero(np.concatenate([[True], np.diff(doc) != 0]))
        ends = np.append(row[1:], len(doc))
        row = np.concatenate([np.arange(a, b, ROW_ENTRIES) for a, b in zip(row, ends)]) if (ends - row).max() > ROW_ENTRIES else row
        positions = pa.ListArray.from_arrays(pa.array(starts, type=pa.int32()), pa.array(at, type=pa.int32()))
        entries = pa.StructArray.from_arrays([self.terms.take(pa.array(code)), pa.array(tf, type=pa.int64()), positions], ["term", "tf", "positions"])
        listed = pa.ListArray.from_arrays(pa.array(np.append(row, len(doc)), type=pa.int32()), entries)
        of = doc[row]
        yield pa.RecordBatch.from_arrays([self.docs.take(pa.array(self.first[of])), pa.array(np.sqrt(squares[of])), listed], ["doc", "l2", "entries"])

    def lists(self) -> Iterator[pa.RecordBatch]:
        """term, docs, n: the documents of each term, and how often they have it together."""
        if not len(self.doc):
            return
        order = np.argsort(self.code, kind="stable")
        code, doc = self.code[order], self.doc[order]
        row = np.flatnonzero(np.concatenate([[True], np.diff(code) != 0]))
        docs = pa.ListArray.from_arrays(pa.array(np.append(row, len(code)), type=pa.int32()), self.docs.take(pa.array(self.first[doc])))
        n = pa.array(np.add.reduceat(self.tf[order], row), type=pa.int64())
        yield pa.RecordBatch.from_arrays([self.terms.take(pa.array(code[row])), docs, n], ["term", "docs", "n"])

    def blocks(self) -> Iterator[pa.RecordBatch]:
        """term, doc, tf, positions, l2: a row per term, whose lists have one value for each of its documents."""
        if not len(self.doc):
            return
        squares = np.bincount(self.doc, weights=self.tf.astype(np.float64) ** 2, minlength=len(self.first))
        order = np.argsort(self.code, kind="stable")
        code, doc, tf = self.code[order], self.doc[order], self.tf[order]
        row = np.flatnonzero(np.concatenate([[True], np.diff(code) != 0]))
        starts = np.concatenate([[0], np.cumsum(tf)])
        at = self.at[np.repeat(self.starts[:-1][order] - starts[:-1], tf) + np.arange(starts[-1])]
        places = pa.ListArray.from_arrays(pa.array(starts, type=pa.int32()), pa.array(at, type=pa.int32()))
        lists = [self.docs.take(pa.array(self.first[doc])), pa.array(tf, type=pa.int64()), places, pa.array(np.sqrt(squares)[doc])]
        edges = pa.array(np.append(row, len(code)), type=pa.int32())
        listed = [pa.ListArray.from_arrays(edges, values) for values in lists]
        yield pa.RecordBatch.from_arrays([self.terms.take(pa.array(code[row])), *listed], ["term", "doc", "tf", "positions", "l2"])

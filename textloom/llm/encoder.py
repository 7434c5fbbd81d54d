"""Fast exact encoding of whole texts with a byte-level BPE file of the tokenizers library.

The pre-tokenizer of a byte-level BPE never joins characters across a single space that stands between
two non-space characters (the space opens a new piece), nor across a letter and a sign after it, the
apostrophe excepted. A text can therefore be cut at both, each piece encoded alone by the library, and
the ids concatenated. Pieces repeat: Arrow numbers the distinct ones of a batch, and a bounded cache per
worker keeps the ids of those seen lately. A text in which a cut would touch further white space, or that
holds the string of a special token (which the library gives that token's id), is given to the library
whole. tests/llm compare both ways.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textloom.llm.common import tokenizer_path

#: Entries of each generation of a worker's cache: some 150 MB at most.
CACHED_PIECES = 350_000
#: Entries that stay when a task ends: the worker process goes on to other work.
KEPT_PIECES = 50_000
LONGEST_CACHED = 48
#: Text encoded at a time: pieces repeat within it, so more costs less, up to the memory it takes.
BATCH_BYTES = 6 << 20
#: A letter and an ASCII sign after it; the apostrophe is no such sign, as contractions bind it.
LETTER_SIGN = r"(\pL)([!-&(-/:-@\[-`{-~])"
_encoders: dict[str, "Encoder"] = {}


def encoder(path: str | None = None) -> "Encoder":
    """One encoder per worker process and vocabulary file."""
    path = path or tokenizer_path()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@contextmanager
def task_encoder(path: str | None = None) -> Iterator["Encoder"]:
    """The worker's encoder for the length of a task."""
    own = encoder(path)
    try:
        yield own
    finally:
        own.pieces.trim(KEPT_PIECES)


class Generations:
    """A bounded dictionary: when the young generation is full it becomes the old one, so entries
    that are still in use survive and the others go."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def keep(self, keys: list[str], values: list[bytes]) -> None:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        self.young.update([(k, v) for k, v in zip(keys, values) if len(k) <= LONGEST_CACHED])

    def trim(self, most: int) -> None:
        """Keep the entries that came first, mostly the common ones, and give back the others' memory."""
        self.old, self.young = {}, dict(islice(self.young.items(), most))


class Encoder:
    def __init__(self, path: str, cached: int = CACHED_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: Strings that the library looks for in a text before it cuts it.
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces = Generations(cached)
        self.opens = np.array([(self.library.id_to_token(k) or "").startswith("Ġ") for k in range(self.library.get_vocab_size())])

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words that consist of letters, each with a space before it: encoded in one run, cut
        where an id that opens with a space begins."""
        out = []
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            ids = np.array(self.library.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.opens[ids]).tolist()
            if len(cuts) != len(part):
                out += self._ids([" " + w for w in part])
            else:
                raw = ids.tobytes()
                out += [raw[4 * a : 4 * b] for a, b in zip(cuts, [*cuts[1:], len(ids)])]
        return out

    def _look_up(self, pieces: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of distinct pieces, and which of them stand beside white space and can't be cut out.

        A piece has a space before it unless NUL marks it as opening its text or as a sign after a letter.
        """
        values = list(map(self.pieces.young.get, pieces))
        gaps, older = [i for i, v in enumerate(values) if v is None], self.pieces.old.get
        words, other, odd = [], [], []
        for i in gaps:
            p = pieces[i]
            if (v := older(p)) is not None:
                values[i] = v
            elif p.isalpha():
                words.append(i)
            elif p.strip() != p or p in ("", "\0") or p[0] == "\0" and p[1].isspace():
                odd.append(i)
            else:
                other.append(i)
        for at, ids in ((words, self._word_ids([pieces[i] for i in words])), (other, self._ids([pieces[i][1:] if pieces[i][0] == "\0" else " " + pieces[i] for i in other]))):
            for i, v in zip(at, ids):
                values[i] = v
        for i in odd:
            values[i] = b""
        known = [i for i in gaps if values[i]]
        self.pieces.keep([pieces[i] for i in known], [values[i] for i in known])
        return values, odd

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, and the n + 1 places where texts begin and end."""
        if not len(texts):
            return np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        texts = texts.cast(pa.large_string()).fill_null("")
        marked = pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        marked = pc.replace_substring_regex(marked, pattern=LETTER_SIGN, replacement="\\1 \0\\2")
        cut = pc.split_pattern(marked, pattern=" ")
        places = cut.offsets.to_numpy().astype(np.int64)
        numbered = cut.flatten().dictionary_encode()
        values, odd = self._look_up(numbered.dictionary.to_pylist())
        index = numbered.indices.to_numpy()
        sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        starts = np.cumsum(sizes) - sizes
        each = sizes[index]
        ends = np.cumsum(each)
        small = np.int32 if max(int(ends[-1]), int(sizes.sum())) < 1 << 31 else np.int64
        at = np.repeat((starts[index] - ends + each).astype(small), each)
        at += np.arange(len(at), dtype=small)
        ids = np.frombuffer(b"".join(values), dtype="<u4")[at]
        bounds = np.concatenate([[0], ends])[places - places[0]]
        whole = set(np.flatnonzero(pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)).tolist())
        for token in self.special:
            whole.update(np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)).tolist())
        if odd:
            whole.update((np.searchsorted(places - places[0], np.flatnonzero(np.isin(index, odd)), "right") - 1).tolist())
        if whole:  # runs of white space, special tokens: those texts go to the library as they are
            order = sorted(whole)
            again = dict(zip(order, self._ids([texts[k].as_py() for k in order])))
            parts = [np.frombuffer(again[k], dtype="<u4") if k in again else ids[bounds[k] : bounds[k + 1]] for k in range(len(texts))]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bounds

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, bounds = self.encode_flat(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

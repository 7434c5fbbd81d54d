"""Words and word shingles as 64-bit hashes, a batch of texts at a time.

Letters A-Z are lower-cased, words are runs of anything but space and the control characters 9 to 13.
A shingle is five consecutive words; a text of one to four words has its whole sequence as its one
shingle, a text without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SHINGLE = 5
_MASK = (1 << 64) - 1
#: Odd multipliers from a rule: hashes of 0, 1, 2, ...
FACTORS = np.array([xxhash.xxh3_64_intdigest(str(k)) | 1 for k in range(SHINGLE)], dtype=np.uint64)
#: Each byte lower-cased if it is A-Z, and every white-space byte a space.
LOWERED = np.array([32 if k in (9, 10, 11, 12, 13) else k + 32 if 65 <= k <= 90 else k for k in range(256)], dtype=np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def numbered_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the number of every word one behind the other, and where texts begin and end."""
    if not len(texts):
        return [], np.zeros(0, np.int64), np.zeros(1, np.int64)
    texts = texts.cast(pa.large_string()).fill_null("")
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    plain = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(starts - starts[0]), pa.py_buffer(LOWERED[data])])
    cut = pc.split_pattern(plain, pattern=b" ")
    places = cut.offsets.to_numpy().astype(np.int64)
    numbered = cut.flatten().dictionary_encode()
    distinct = numbered.dictionary.to_pylist()
    index = numbered.indices.to_numpy()
    real = np.array([x != b"" for x in distinct], dtype=bool)[index] if len(index) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(real)])
    return distinct, index[real], kept[places - places[0]]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one behind the other, and the n + 1 places where texts begin and end."""
    distinct, index, bounds = numbered_words(texts)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), dtype=np.uint64, count=len(distinct))
    return hashes[index], bounds


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the ascending distinct hashes of its shingles."""
    words, bounds = word_hashes(texts)
    if len(words) >= size:
        n = len(words) - size + 1
        runs = words[:n] * FACTORS[0]
        for k in range(1, size):
            runs += words[k : k + n] * FACTORS[k]
        runs = mixed(runs)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            own = np.sort(runs[a : b - size + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            whole = np.array([b - a], dtype=np.uint64) + (words[a:b] * FACTORS[: b - a]).sum(dtype=np.uint64)
            out.append(mixed(whole * FACTORS[0]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out

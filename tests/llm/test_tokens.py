"""Encoder, token files, packing."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from textloom.llm import packing, token_files
from textloom.llm.encoder import Encoder, encoder
from textloom.llm.common import tokenizer_path

from .conftest import ODD


LIBRARY = Tokenizer.from_file(tokenizer_path())


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_equals_the_library():
    rng = random.Random(5)
    signs = "ab é'.,!\n\t  s:;$_^`~{}|  中1٣²ʰ́\0<|"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["it's o'k 'tis", "<|endoftext|> hi", "a<|endoftext|>b <|endoftext|>", "<|endoftext |>", "x <|endoftext|><|endoftext|>", " lead", "trail ", "a  b", "", *[t or "" for _, t in ODD]]
    small = Encoder(tokenizer_path(), cached=50)
    for one in (encoder(), small):
        for _ in range(2):
            assert [x.tolist() for x in one.encode(texts)] == [plain(t) for t in texts]


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [3, 9, 100, 101, 1 << 40], list(range(0, 5000, 7)), [-5, 0, 2**62]])
def test_elias_fano(values):
    packed = token_files.EliasFano(b"xx" + token_files.ef_pack(np.array(values, dtype=np.int64)), 2)
    assert packed.all().tolist() == values
    assert [packed.select(k) for k in range(len(values))] == values
    with pytest.raises(IndexError):
        packed.select(len(values))


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 100_000))
    assert len(token_files.ef_pack(ends)) * 8 / len(ends) < 2 + np.log2(1000) + 1.5


def test_token_files_round_trip(spark, small):
    docs, texts = small
    files = token_files.write_files(docs, file_ids=5000)
    assert files.count() > 3
    rows = {r["doc_id"]: r for r in token_files.read_files(files).collect()}
    at = 0
    for doc_id, text in texts:
        ids = [*plain(text), 0]
        assert (rows[doc_id]["start"], rows[doc_id]["n_tokens"], rows[doc_id]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_special_strings_have_their_own_id():
    assert plain("<|endoftext|>") == encoder().encode(["<|endoftext|>"])[0].tolist() and len(plain("<|endoftext|>")) == 1


def test_files_at_a_given_place(spark, small, tmp_path):
    docs, texts = small
    files = token_files.write_files(docs, file_ids=5000, to=str(tmp_path / "table"))
    names = {r["name"]: r["bytes"] for r in token_files.export(files, str(tmp_path / "files")).collect()}
    token_files.export(files, str(tmp_path / "files"))
    assert sorted(names) == sorted(x.name for x in (tmp_path / "files").iterdir()) and len(names) > 3
    found = []
    for name in sorted(names):
        data = (tmp_path / "files" / name).read_bytes()
        assert len(data) == names[name]
        file = token_files.TokenFile(data)
        found += [(d, file.ids(k).tolist()) for k, d in enumerate(file.doc_ids())]
    assert found == [(d, [*plain(t), 0]) for d, t in texts]


def test_token_files_odd(odd, none):
    rows = token_files.read_files(token_files.write_files(odd)).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [-3, 1, 2, 3, 4, 4, 5, 6, 7, None]
    assert sum(r["n_tokens"] for r in rows) == sum(len(plain(t)) + 1 for _, t in ODD)
    assert token_files.read_files(token_files.write_files(none)).collect() == []


def test_cut_points():
    assert packing.cut_points(1) == [(0, 1)] and packing.cut_points(1024) == [(0, 1024)]
    assert packing.cut_points(2500) == [(0, 452), (452, 1024), (1476, 1024)]
    assert packing.cut_points(2048) == [(0, 1024), (1024, 1024)]


def filled(histogram, capacity):
    """Sequences that a plan describes, checked for overlap and capacity."""
    intervals, used = packing.plan(histogram, capacity)
    ranks, sequences = Counter(), {}
    for n, (length, rank, each, first, offset) in enumerate(intervals):
        stop = intervals[n + 1][1] if n + 1 < len(intervals) and intervals[n + 1][0] == length else histogram[length]
        assert rank == ranks[length]
        for r in range(rank, stop):
            q, k = divmod(r - rank, each)
            sequences.setdefault(first + q, []).append((offset + k * length, length))
        ranks[length] = stop
    assert ranks == Counter(histogram) and set(sequences) == set(range(used))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return used


def best_fit(histogram, capacity):
    """Best fit over single pieces in falling order."""
    free = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [k for k, room in enumerate(free) if room >= length]
            if fits:
                free[min(fits, key=lambda k: free[k])] -= length
            else:
                free.append(capacity - length)
    return len(free)


@pytest.mark.parametrize("seed", range(6))
def test_plan_packs_as_best_fit_does(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(20)}
    assert filled(histogram, 64) == best_fit(histogram, 64)


def test_plan_size_does_not_follow_the_counts():
    small, large = ({n: f * (n % 7 + 1) for n in range(1, 1025)} for f in (100, 100_000_000))
    assert len(packing.plan(large)[0]) < 1.2 * len(packing.plan(small)[0]) + 100 < 1024**2


def check_packed(rows, texts, capacity=1024):
    per_doc, per_sequence = {}, {}
    for r in rows:
        per_doc.setdefault(r["doc_id"], []).append(r)
        per_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, text in texts:
        ids, at = [*plain(text), 2], 0
        for k, r in enumerate(sorted(per_doc[doc_id], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, crc(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    for pieces in per_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return len(per_sequence)


def test_packing(small):
    docs, texts = small
    rows = packing.pack(docs).collect()
    total = sum(r["length"] for r in rows)
    assert check_packed(rows, texts) <= -(-total // 1024) * 1.02 + 1


def test_packing_odd(odd, none):
    rows = packing.pack(odd).collect()
    assert sum(r["length"] for r in rows) == sum(len(plain(t)) + 1 for _, t in ODD)
    assert packing.pack(none).collect() == []


def test_ranks_split_a_hot_length(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 0, 0, 3, 0)] * 500 + [(7, 1, 0, 4, 1)], packing.PIECES).withColumn("mark", F.monotonically_increasing_id())
    dealt = packing.ranked(rows, {3: 500, 4: 1}, "mark", ranked_rows=20)
    assert sorted(r["rank"] for r in dealt.collect() if r["length"] == 3) == list(range(500))


def test_full_pieces_stand_alone(spark):
    docs = spark.createDataFrame([(1, "word " * 5000), (2, "a b c")], "doc_id long, text string")
    rows = packing.pack(docs, capacity=16).collect()
    full = [r for r in rows if r["length"] == 16]
    assert len({r["sequence_id"] for r in full}) == len(full) > 300 and {r["offset"] for r in full} == {0}
    assert not {r["sequence_id"] for r in full} & {r["sequence_id"] for r in rows if r["length"] < 16}

"""The pipeline's stages on the smallest tables, and what the entry module offers."""

import itertools

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from textloom.llm import packing, queries

from . import test_decontamination, test_jaccard, test_lines, test_tokens
from .conftest import ODD


def test_stages_do_what_their_operators_say(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    counts, now = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.schema.simpleString() == docs.schema.simpleString(), name
        counts.append(now.count())
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0]
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in now.collect()}


LAST = (1 << 63) - 1


def by_hand(texts, good, items):
    """What the pipeline keeps of (doc_id, text), stage by stage in plain Python; good names the doc_ids that the
    classifier doesn't reject. Rows that share a doc_id have to be equal."""
    now = [(LAST if d is None else d, t) for d, t in texts if good is None or d in good]
    now.sort(key=lambda r: r[0])
    gone = dict(test_lines.expected(now))
    kept = []
    for d, t in now:
        left = [x for k, x in enumerate((t or "").split("\n")) if k not in gone.get(d, ())]
        if d not in gone or any(x.strip(" \t\n\x0b\f\r") for x in left):
            kept.append((d, "\n".join(left) if d in gone else t))
    one, out = test_jaccard.brute(kept), []
    for d, t in kept:
        n, component = one[d]
        if n == 0 or component == d and (d, t) not in out:
            out.append((d, t))
    leaking = {d for d, _ in test_decontamination.holding(out, items)}
    return [(None if d == LAST else d, t) for d, t in out if d not in leaking]


def check_whole(spark, folder, texts, good):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = []
    for d, t in by_hand(texts, good, items):
        ids = [*test_tokens.plain(t), 2]
        want += [(d, k, start, n, test_tokens.crc(ids[start : start + n])) for k, (start, n) in enumerate(packing.cut_points(len(ids)))]
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted((tuple(r[:5]) for r in rows), key=str) == sorted(want, key=str)
    per_sequence = {}
    for r in rows:
        per_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in per_sequence.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(own))]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 1024


def test_whole_pipeline_by_hand(spark, small, folder):
    good = {r["doc_id"] for r in queries.op10_quality(spark, folder).collect() if r["predicted"] == 1}
    assert 0 < len(good) < len(small[1])
    check_whole(spark, folder, small[1], good)


def test_whole_pipeline_on_odd_and_empty_tables(spark, odd, none, folder, tmp_path):
    """Without labels of both classes nothing is rejected."""
    for name, docs, texts in (("odd", odd, ODD), ("none", none, [])):
        place = tmp_path / name
        docs.write.parquet(str(place / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(place / "labels.parquet"))
        spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(place / "benchmark.parquet"))
        check_whole(spark, str(place), texts, None)


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(queries.queries()) < set(names) and set(__spark_entry__.oracle_sql()) < set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    answer = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in answer.description]
    found = queries.queries()[name](spark, folder).select(*names)
    assert sorted(map(tuple, found.collect())) == sorted(answer.fetchall())

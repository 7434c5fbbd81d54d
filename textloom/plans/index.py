"""Inverted index with positions, document norms, and merging of indexes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.counts import Counts, whole_documents
from textloom.functions.stem import stemmed_vocabulary
from textloom.functions.text import index_words

#: Text of a task that sorts blocks by term. The sort takes some seventeen times this.
TASK_BYTES = 16 << 20
#: Writer's options for blocks: pages of few terms, so that a reader passes over most of a file.
SMALL_PAGES = {"parquet.page.row.count.limit": "2000"}


def term_positions(docs: DataFrame, words: Column | None = None) -> DataFrame:
    """doc, term, position (from 1) for every word; blank words count but give no row."""
    words = index_words(F.col("text")) if words is None else words
    return docs.select("doc", F.posexplode(words).alias("at", "term")).where("term is not null").select("doc", "term", (F.col("at") + 1).alias("position"))


def with_stems(positions: DataFrame) -> DataFrame:
    """Adds a row under the stem where it differs; the stemmer runs once per distinct term."""
    stems = stemmed_vocabulary(positions.select("term")).where("stem <> term")
    return positions.unionByName(positions.join(stems, "term").select("doc", F.col("stem").alias("term"), "position"))


def postings(positions: DataFrame) -> DataFrame:
    """doc, term, tf, positions (ascending)."""
    return positions.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"))


def norms(post: DataFrame) -> DataFrame:
    """doc, l2: root of the summed squares of its term counts."""
    return post.groupBy("doc").agg(F.sqrt(F.sum((F.col("tf") * F.col("tf")).cast("double"))).alias("l2"))


def build(docs: DataFrame, words: Column | None = None, stems: bool = True, only: list[str] | None = None) -> DataFrame:
    """term, doc, tf, positions, l2 of documents (doc, text); of the terms in `only`, where given, by the norms of all.

    Texts are dealt by document once; words are then counted, and norms added up, document by document where they
    are, so that no row of a word is sorted or dealt.
    """
    counted = _counted(docs, words, stems, "documents", only)
    return counted.select("doc", "l2", F.inline("entries")).select("term", "doc", "tf", "positions", "l2")


def document_lists(docs: DataFrame, words: Column | None = None, stems: bool = True) -> DataFrame:
    """term, docs (ascending), n: the documents of each term and how often they have it together.

    A task joins the documents of some megabytes of text before they are dealt by term.
    """
    found = _counted(docs, words, stems, "lists").groupBy("term")
    return found.agg(F.sort_array(F.flatten(F.collect_list("docs"))).alias("docs"), F.sum("n").alias("n"))


def blocks(docs: DataFrame, n_bytes: int, words: Column | None = None, stems: bool = True) -> DataFrame:
    """The whole index in the form to store: term, and lists doc, tf, positions, l2 with a value for each document.

    A row has the documents of a term in some megabytes of text, and a task's rows are in order of term, so that a
    file is an index of its own and is read by term. No posting is dealt; a frequent term lies in many rows. The
    bytes of all texts decide how many tasks there are.
    """
    return _counted(docs, words, stems, "blocks", tasks=1 + n_bytes // TASK_BYTES).sortWithinPartitions("term")


def opened(stored: DataFrame, *columns: str) -> DataFrame:
    """term and the asked columns of `blocks`, a row per document; other lists aren't read, and filters by term reach the scan."""
    return stored.select("term", F.inline(F.arrays_zip(*columns)))


def _counted(docs: DataFrame, words: Column | None, stems: bool, form: str, only: list[str] | None = None, tasks: int | None = None) -> DataFrame:
    cut = docs.select("doc", F.col("text").alias("words") if words is None else words.alias("words"))
    dealt = (cut.repartition("doc") if tasks is None else cut.repartition(tasks, "doc")).sortWithinPartitions("doc")
    kind = docs.schema["doc"].dataType.simpleString()
    schema = {
        "documents": f"doc {kind}, l2 double, entries array<struct<term: string, tf: bigint, positions: array<int>>>",
        "lists": f"term string, docs array<{kind}>, n bigint",
        "blocks": f"term string, doc array<{kind}>, tf array<bigint>, positions array<array<int>>, l2 array<double>",
    }[form]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_documents(batches):
            counts = Counts(rows, stems)
            yield from counts.documents(only) if form == "documents" else getattr(counts, form)()

    return dealt.mapInArrow(count, schema)


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Postings of both; where both have a (term, doc), the new one."""
    return new.unionByName(old.join(new.select("term", "doc"), ["term", "doc"], "left_anti"))


def document_frequency(post: DataFrame, n_docs: int | Column) -> DataFrame:
    """term, df, idf = ln(n / df)."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return post.groupBy("term").agg(F.count_distinct("doc").alias("df")).withColumn("idf", F.log(n / F.col("df")))

"""Ranked search, autocomplete and spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.stem import stem

DEFAULT_RANK = 0.15
FURTHEST = 2


def query_terms(query: str) -> list[str]:
    """Each word's stem, and the word where they differ; lower case, once each."""
    out = {}
    for word in query.split():
        root = stem(word)
        out[root.lower()] = None
        if root.lower() != word.lower():
            out[word.lower()] = None
    return list(out)


def term_counts(queries: DataFrame) -> DataFrame:
    """term, n: how often each lower-case word is asked for in queries (query). It weights no score."""
    words = queries.select(F.explode(F.split(F.lower("query"), r"\s+")).alias("term")).where("term <> ''")
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def search(post: DataFrame, ranks: DataFrame, terms: list[str], n_docs: int) -> DataFrame:
    """doc, score: summed tf/l2 * idf over the terms, times the document's rank; best first, ties by doc.

    post has term, doc, tf, l2. Terms are few: the filter reaches the index's scan, and the frequencies
    are counted over the same rows.
    """
    hits = post.where(F.col("term").isin(terms))
    frequency = hits.groupBy("term").agg(F.count_distinct("doc").alias("df"))
    scored = hits.join(F.broadcast(frequency), "term")  # a row per query term
    weight = F.col("tf") / F.col("l2") * F.log(F.lit(n_docs) / F.col("df"))
    per_doc = scored.groupBy("doc").agg(F.sum(weight).alias("tfidf"))
    ranked = per_doc.join(ranks.select("doc", "rank"), "doc", "left")
    return ranked.select("doc", (F.col("tfidf") * F.coalesce("rank", F.lit(DEFAULT_RANK))).alias("score")).orderBy(F.desc("score"), "doc")


def autocomplete(terms: DataFrame, prefix: str, most: int = 10) -> DataFrame:
    """The first terms that begin with the prefix, whatever the case."""
    return terms.where(F.lower("term").startswith(prefix.lower())).select("term").distinct().orderBy("term").limit(most)


def correct(terms: DataFrame, words: list[str], furthest: int = FURTHEST) -> DataFrame:
    """word, suggestion, distance: the nearest term within `furthest` edits, ties by term, for words that
    begin no term."""
    spark: SparkSession = terms.sparkSession
    asked = spark.createDataFrame([(w,) for w in words], "word string")
    distinct = terms.select("term").distinct()
    begun = distinct.join(F.broadcast(asked), F.lower("term").startswith(F.lower("word"))).select("word").distinct()
    near = distinct.join(F.broadcast(asked), F.abs(F.length("term") - F.length("word")) <= furthest)
    near = near.withColumn("distance", F.levenshtein("word", "term", furthest)).where("distance >= 0")
    best = near.groupBy("word").agg(F.min(F.struct("distance", "term")).alias("best")).select("word", "best.term", "best.distance")
    return best.join(begun, "word", "left_anti").select("word", F.col("term").alias("suggestion"), "distance")

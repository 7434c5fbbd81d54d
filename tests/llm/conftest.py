import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, class string, line int, score double, _marks string, key string"


def documents(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    full = [(i, t, "en", "s", None if t is None else len(t), "c", 1, 0.5, "m", "k") for i, t in rows]
    return spark.createDataFrame(full, COLUMNS)


LONG = " ".join(f"word{k % 997} filler{k % 13}" for k in range(30_000))
ODD = [
    (1, None), (2, ""), (3, "  \n\n \t"), (4, "One line of several plain words here.\nAnother one follows it, of course."), (4, "One line of several plain words here.\nAnother one follows it, of course."),
    (None, "No identifier but a text of quite a few words all the same."), (5, LONG), (6, "x"), (7, "<|endoftext|> é ñ 中文 \x00 \U0001f600"), (-3, "negative"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def small(spark, folder):
    """(doc_id, text) of the smallest table, as a DataFrame and as a list."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs, sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())

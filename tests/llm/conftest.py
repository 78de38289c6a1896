import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, entity long, key string, length int, rank int, __gone_id long, item_id long, stats binary"


def docs_of(spark, rows):
    """A documents table with extra columns whose names clash with inner ones; rows: (doc_id, text)."""
    return spark.createDataFrame([(i, t, None if k % 3 else "en", "s", None if t is None else len(t), 7, "k", 1, 2, i, 5, None) for k, (i, t) in enumerate(rows)], SCHEMA)


EDGE = [
    (1, None), (2, ""), (3, "   \n\n "), (None, "a text without an id but with words"), (None, None), (4, "one"), (5, "one"), (5, "one"),
    (6, "Word " * 30_000), (7, "Ünï cödé 日本語 🙂 tëxt with odd blanks"), (8, "!!! ??? ***"), (9, "two words"), (10, "x" * 50_000),
]


@pytest.fixture(scope="session")
def edge(spark):
    return docs_of(spark, EDGE)


@pytest.fixture(scope="session")
def none(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: docs_of(spark, rows)

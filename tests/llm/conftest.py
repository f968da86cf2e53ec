from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
LONG = "so long a text " * 4000

#: (doc_id, text, source): nulls in every column, empty and very long texts, ties, repeated rows.
ROWS = [
    (7, "the quick brown fox jumps over the lazy dog again and again", "b"), (7, "the quick brown fox jumps over the lazy dog again and again", "b"), (3, "the quick brown fox jumps over the lazy dog again and again", "a"),
    (5, "", "a"), (6, None, None), (None, "a row without a key", "c"), (None, None, None), (8, " \n\t ", "c"), (9, LONG, "b"), (10, LONG, None), (7, "another text under the same key", "b"), (11, "One TWO\nOne TWO\nthree", "a"), (12, "one two\none two\nthree", "d"), (2, "é ß 日本  x #tag $5 100%", "a"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """The edge rows, with more columns whose names operators use for their own."""
    rows = [(i, t, "en", s, None if t is None else len(t), 1, "x", 2.0) for i, t, s in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def tables(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")

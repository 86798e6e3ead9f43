import random

import pytest


def words(rng, n, vocabulary=60):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture
def awkward(spark):
    """Rows with nulls in every column, empty and long texts, ties, repeated rows and an extra column."""
    rows = [
        (1, "a b c d e f", "en", "s1", 6, "x"), (1, "a b c d e f", "en", "s1", 6, "x"), (2, "a b c d e f", None, "s1", 6, "x"), (3, None, "en", None, None, None),
        (4, "", "de", "s2", 0, "x"), (5, " \n\t ", "de", "s2", 4, "x"), (None, "some text here", "fr", "s3", 14, "x"), (6, "word " * 30_000, "es", None, 150_000, "x"),
        (7, "a b ünï ▁ \U0001f600 c", "en", "s3", 12, "x"), (8, "x" * 2000, "en", "s3", 2000, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def rng():
    return random.Random(5)

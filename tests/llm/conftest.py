"""Awkward documents that every operator must take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, dropped_id int, copies string, label double"


def documents(spark, rows):
    """Rows of (doc_id, text, source), with columns whose names operators use, too."""
    return spark.createDataFrame([(i, t, None, s, None, 1, "x", 0.5) for i, t, s in rows], SCHEMA)


AWKWARD = [
    (1, "One two three four five six seven.\nOne two three four five six seven.", "a"),
    (2, "one two three four five six seven.\none two three four five six seven.", "b"),
    (3, None, "a"), (4, "", None), (5, " \t\n\x0b\x0c\r ", "b"), (None, "lost one two three", "a"),
    (7, "repeated row with some words", "c"), (7, "repeated row with some words", "c"),
    (8, "word " * 30_000, "a"), (9, "naïve Ünïcode  text \U0001f600 <|endoftext|> 's x  y", None),
    (10, "x" * 50_000, "c"),
]


@pytest.fixture
def awkward(spark):
    return documents(spark, AWKWARD)


@pytest.fixture
def empty(spark):
    return documents(spark, [])


@pytest.fixture
def make(spark):
    return lambda rows: documents(spark, rows)

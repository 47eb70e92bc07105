import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts, lang="en", source="s0"):
    return [(k, t, lang, source, None if t is None else len(t)) for k, t in enumerate(texts)]


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    return ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def prose(words):
    rng = random.Random(6)
    return lambda n: " ".join(rng.choices(words, k=n))


@pytest.fixture(scope="session")
def edge_rows(prose):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long = prose(30_000)
    return [
        (1, None, None, None, None), (2, "", "en", "s0", 0), (3, " \n\t ", "en", "s1", 4), (4, "a", "en", "s1", 1), (5, long, "en", "s1", len(long)),
        (6, "12345 !!! ***", None, "s1", 13), (7, prose(40), "en", "s2", 1), (8, prose(40), "en", "s2", 1), (8, "repeated row with ten words in it or even more", "en", "s2", 1),
        (8, "repeated row with ten words in it or even more", "en", "s2", 1), (None, prose(40), "en", None, None), (None, None, None, None, None),
        (9, "é ü ñ \U0001f600 Σ İ \x1c\x85 <|endoftext|> don't'LL", "fr", "s3", 9),
    ]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

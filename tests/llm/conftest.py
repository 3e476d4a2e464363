import random

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing column names."""
    r = random.Random(3)
    words = ["the", "and", "ing", "tion", "der", "und", "schen", "los", "que", "año"]
    long = " ".join(r.choice(words) for _ in range(40_000))
    rows = [
        (1, "the cat and the dog are thinking", "en", "a", 1, "x"),
        (2, None, "en", None, None, "x"),
        (3, "", None, "", 0, None),
        (4, "   \n\t ", None, "a", 5, "x"),
        (5, long, "de", "a", len(long), "x"),
        (6, long, "de", "b", len(long), "x"),
        (7, "12345 !!! 😀", None, "a", 9, "x"),
        (None, "the cat and the dog are thinking", "en", "a", 1, "x"),
        (1, "the cat and the dog are thinking", "en", "a", 1, "x"),
        (8, "der Hund und die Katze schlafen", "de", "a", 1, "x"),
    ]
    # id, n, component, score and key are names that operators use themselves.
    return spark.createDataFrame([(*row, 0, "k") for row in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, n int, key string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)

import random

import pytest

LETTERS = "bcdfglmnprst"
VOWELS = "aeiou"


def word(rng):
    return "".join(rng.choice(LETTERS) + rng.choice(VOWELS) for _ in range(rng.randint(2, 3)))


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def sentence(rng):
    """A function that makes a sentence of n words from a large vocabulary."""
    return lambda n=8: (" ".join(word(rng) for _ in range(n)).capitalize() + rng.choice(".!?,"))


def hostile(spark, extra=()):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    long = "long text, of words. " * 20_000
    rows = [
        (1, "Some plain text here.", "en", "a", 21, 0, "x"),
        (1, "Some plain text here.", "en", "a", 21, 0, "x"),
        (2, None, None, None, None, None, None),
        (None, "Some plain text here.", None, "a", None, 1, "y"),
        (3, "", "de", "b", 0, 1, "z"),
        (4, " \n\t .,; ", "xx", None, 5, 1, "z"),
        (5, long, "fr", "c", len(long), 2, None),
        (6, "zwölf Böxkämpfer – jagen 😀 Viktor", "de", "c", 30, 2, "w"),
        *extra,
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, cell int, TEXT string")


NO_DOCS = "doc_id long, text string, lang string, source string, n_chars long"

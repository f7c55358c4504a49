import random

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rnd = random.Random(5)
    long = " ".join(rnd.choice("alpha beta gamma delta".split()) + str(rnd.randint(0, 99)) for _ in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en"), (1, "the quick brown fox jumps over the lazy dog", "en"), (2, None, None), (3, "", "en"),
        (None, "the quick brown fox jumps over the lazy dog", None), (None, None, None), (4, long, "en"), (5, "   \n\t ", "de"), (6, "123 456 !!!", None),
        (7, "der schnelle braune fuchs springt", "de"), (8, "Ünïcödé 😀 naïve café", "fr"), (9, "the quick brown fox jumps over the lazy cat", "en"),
    ]
    full = [(i, t, x, None, None, "x", 0.5, 7) for i, t, x in rows]
    return spark.createDataFrame(full, DOCS + ", lang_pred string, score double, fp long")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

"""Helpers for tests of the training-data operators."""

import pytest

#: Texts that every operator must take: null, empty, spaces, marks, a long text, repeats.
ODD = [None, "", " ", "\n\n", "a", "é‍👩‍👧 ñ", "word " * 3000, "x" * 5000, "same text here again now", "same text here again now"]


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of texts, with columns whose names operators use inside."""

    def make(texts, first=0):
        rows = [(first + i, t, "en", "s", "k", 1, "r") for i, t in enumerate(texts)]
        names = "doc_id bigint, text string, lang string, source string, key string, n int, ranges string"
        return spark.createDataFrame(rows, names)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)

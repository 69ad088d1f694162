"""Small tables with the awkward cases that all operators must take."""

import pytest

LONG = "lorem ipsum dolor " * 20_000

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, rep long, token string"


def rows_of(texts, start=0):
    return [(start + i, t, "en", "s", len(t or ""), "x", 1, 2, "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs_of(spark):
    """docs_of(texts, extra rows): a documents table with extra columns named like inner ones."""

    def make(texts, more=()):
        return spark.createDataFrame(rows_of(texts) + list(more), DOCS)

    return make


@pytest.fixture(scope="session")
def awkward(docs_of):
    """Null id, null text, null lang and source, empty, blank and very long texts, repeated rows."""
    same = (50, "one two three four five six seven eight", None, None, None, None, None, None, None)
    return docs_of(
        ["a b c d e f", None, "", " \n\t ", "word", LONG, "über größe ñandú 日本語"],
        [same, same, (None, "no id at all here", "de", None, 1, None, None, None, None),
         (None, None, None, None, None, None, None, None, None)])

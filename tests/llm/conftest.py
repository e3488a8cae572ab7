"""Small helpers for tables that tests make up."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, sources=None, ids=None):
        ids = range(len(texts)) if ids is None else ids
        sources = ["s"] * len(texts) if sources is None else sources
        rows = [(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources)]
        return spark.createDataFrame(rows, DOCS)

    return make

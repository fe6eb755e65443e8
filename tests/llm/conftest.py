import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, line string, key string, pos int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, source) triples, with extra columns whose names clash with inner ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", 1) for i, t, s in rows], DOCS)

    return make

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, kept int, label string"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows, with extra columns whose names clash with internal ones."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None, "x", "y", 1, "z") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make

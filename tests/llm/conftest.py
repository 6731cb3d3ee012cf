import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) rows; extra columns may follow."""

    def make(rows, schema=DOCS):
        return spark.createDataFrame([(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, long, repeated and odd texts."""
    return [(0, None), (1, ""), (2, "   \n\t "), (3, "word " * 5000), (4, "x" * 20000), (5, "same text here"), (6, "same text here"), (7, "é" * 300 + "\U0001f600"), (None, "no id"), (8, "1" * 5000), (8, "twice an id")]

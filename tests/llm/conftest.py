import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def documents(spark):
    def make(rows):
        full = [(i, t, *(rest or ("en", "s0")), len(t or "")) for i, t, *rest in rows]
        return spark.createDataFrame(full, DOCS)

    return make

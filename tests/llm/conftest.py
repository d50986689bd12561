import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)

    return make

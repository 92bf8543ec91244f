import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from thresher.llm.shared import ship_package

    ship_package(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of `documents` from (doc_id, text[, lang, source]) tuples."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def make(rows):
        full = [(r + (None, None, None))[:4] for r in rows]
        return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in full], schema)

    return make

import pytest

from fleetlens.llm.common import prepare


@pytest.fixture(scope="session")
def docs_of(spark):
    """DataFrame of (doc_id, text, lang, source, n_chars) rows from (doc_id, text) pairs, lang en."""
    prepare(spark)

    def make(pairs, lang="en"):
        rows = [(i, t, lang, "s", len(t) if t is not None else None) for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make

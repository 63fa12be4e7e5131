import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of texts, in order, with columns that clash with those of the operators."""

    def make(texts, first=0, **columns):
        rows = [(i + first, t, columns.get("lang", ["en"] * len(texts))[i], columns.get("source", [None] * len(texts))[i], None if t is None else len(t), "x", "y", 1) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, node string, _n int")

    return make

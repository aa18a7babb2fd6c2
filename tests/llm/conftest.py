import pytest
from odd_documents import ODD

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, spans int"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts (ids count up) or (id, text) pairs; two more columns clash with names of results."""

    def build(*texts, source="s"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", source, len(t or ""), "mine", 7) for i, t in rows]
        return spark.createDataFrame(rows, COLUMNS)

    return build


@pytest.fixture(scope="session")
def odd(docs_of):
    return docs_of(*ODD)


@pytest.fixture(scope="session")
def empty(docs_of, odd):
    return odd.limit(0)

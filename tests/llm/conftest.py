import pytest


@pytest.fixture(scope="session")
def shared(spark):
    """The session of the tests, which names a checkpoint folder as a cluster does."""
    return spark


@pytest.fixture(scope="session")
def docs_of(shared):
    """A documents table of the given (doc_id, text) rows, with extra columns whose names clash with the operators' own."""

    def make(rows, schema="doc_id bigint, text string, th int, lang string, source string, mini string, n_words string"):
        return shared.createDataFrame([(i, t, 0, "en", "src", "x", "y") for i, t in rows], schema).repartition(3)

    return make

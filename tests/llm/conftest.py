import pytest


@pytest.fixture
def docs(spark):
    """A maker of document tables; columns that operators make themselves come along to clash."""

    def make(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, i, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, mark string")

    return make

import pytest


@pytest.fixture()
def frame(spark):
    """A table of documents with clashing extra columns."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "x", 7, 8) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, n_pieces string, score int, lines_removed int")

    return make

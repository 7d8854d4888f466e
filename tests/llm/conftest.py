import pytest


@pytest.fixture
def docs(spark):
    def make(*rows, extra=""):
        """(doc_id, text[, more]) as a table with the columns of documents."""
        schema = "doc_id long, text string" + extra
        return spark.createDataFrame(list(rows), schema)

    return make

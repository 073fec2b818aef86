import pytest

from filigree.llm.queries import ORACLE


@pytest.fixture(scope="session")
def clashing(spark):
    """Documents with nulls, empty and repeated rows, and extra columns named like the operators' own."""

    def make(rows, columns="doc_id bigint, text string"):
        data = [(*row, "x", 1, "y", 2.0, True, b"z") for row in rows]
        extra = ", id string, fp int, row string, score double, kept boolean, digest binary"
        return spark.createDataFrame(data, columns + extra).repartition(3)

    return make


@pytest.fixture(scope="session")
def oracle():
    return ORACLE

import itertools

import pytest

from starloom.llm.common import Scratch

_number = itertools.count()


@pytest.fixture
def scratch(spark):
    """A new folder for intermediate tables per use."""
    return lambda: Scratch(spark, f"test{next(_number)}")


@pytest.fixture
def documents(spark):
    """(doc_id, text) rows as a table, with more columns of names that operators use themselves."""

    def make(rows, parts=3):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        return frame.repartition(parts) if rows else frame

    return make


@pytest.fixture
def clashing(documents):
    """The same with columns named like those that operators add."""
    names = "n component_id linked sig center rep removed n_lines place copies length rank lang_pred _n _row g".split()

    def make(rows):
        return documents(rows).selectExpr("doc_id", "text", *[f"'x' AS {n}" for n in names])

    return make

"""Every registered query against its DuckDB SQL, by value."""

import math
from collections import Counter

import pytest

import __spark_entry__ as entry
from tests.conftest import TESTDATA

SCALE = "0.01"


def rows_of(columns, rows):
    """Rows as a multiset, columns in name order; NaN equals itself."""
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def norm(value):
        return "NaN" if isinstance(value, float) and math.isnan(value) else value

    return Counter(tuple(norm(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="module")
def connection(duck):
    return duck(SCALE)


LLM = {*entry.llm.QUERIES, "pipeline"} if entry.llm else set()  # these have tests of their own


def test_every_query_has_expected_results():
    assert set(entry.queries()) - LLM == set(entry.oracle_sql()) - LLM


@pytest.mark.parametrize("name", [name for name in entry.queries() if name not in LLM])
def test_query(spark, connection, name):
    df = entry.queries()[name](spark, f"{TESTDATA}/sf{SCALE}")
    expected = connection.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(df.columns) == sorted(columns)
    want, got = rows_of(columns, expected.fetchall()), rows_of(df.columns, df.collect())
    assert sum(got.values()) > 0
    assert got == want, f"too many {list((got - want).items())[:3]}, missing {list((want - got).items())[:3]}"


def test_payments_summed_over_items_would_be_too_high(spark):
    sf_dir = f"{TESTDATA}/sf{SCALE}"
    months = entry.queries()["q_payment_total_per_month"](spark, sf_dir).collect()
    assert round(sum(r.payments for r in months), 2) == 619_303_499.40
    fact = entry.queries()["fact_sales"](spark, sf_dir)
    assert round(fact.agg({"payment_value": "sum"}).first()[0], 2) == 2_140_139_888.53


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["year", "month", "month_name", "revenue", "items"]
    assert df.count() > 0

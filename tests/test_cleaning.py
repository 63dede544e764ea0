"""Cleaning primitives and silver tables on small hand-made frames."""

import math

import pytest
from pyspark.sql import functions as F

from starloom.functions.calendar import calendar_columns, date_key
from starloom.functions.casts import int_columns, int_from_text, zip_text
from starloom.functions.money import round_money, sum_money
from starloom.operators.cleaning import (
    dedupe_by_key,
    distinct_rows,
    drop_nulls,
    first_by_key,
    within_box,
)
from starloom.plans import silver

NAN = float("nan")


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.ansi.enabled", before)


def test_drop_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, None), (1, 2)], "a int, b int")
    assert values(drop_nulls(df)) == [(1, 2)]
    assert values(drop_nulls(df, how="all")) == [(1, 2), (1, None)]
    floats = spark.createDataFrame([(1, NAN), (2, 0.5)], "a int, b double")
    assert values(drop_nulls(floats)) == [(2, 0.5)]


def test_distinct_rows_take_nulls_nans_and_zeros_as_equal(spark):
    df = spark.createDataFrame([(None,), (None,), (NAN,), (NAN,), (0.0,), (-0.0,)], "a double")
    assert distinct_rows(df).count() == 3


def test_dedupe_keeps_the_smallest_rest_nulls_first(spark):
    rows = [(1, "b", 1), (1, "a", 9), (1, "a", 3), (2, None, 5), (2, "a", 0), (None, "x", 1), (None, "w", 2)]
    df = spark.createDataFrame(rows, "k int, s string, n int").repartition(5)
    assert values(dedupe_by_key(df, ["k"])) == [(1, "a", 3), (2, None, 5), (None, "w", 2)]
    assert dedupe_by_key(df, ["k"]).columns == df.columns
    assert dedupe_by_key(df.select("k"), ["k"]).count() == 3


def test_dedupe_of_empty_input(spark):
    assert dedupe_by_key(spark.createDataFrame([], "k int, v int"), ["k"]).count() == 0


def test_dedupe_limits_rows_per_key_before_the_shuffle(spark):
    df = dedupe_by_key(spark.range(100).selectExpr("id % 3 AS k", "id AS v"), ["k"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan[plan.index("WindowGroupLimit") :]


def test_first_by_key_takes_all_fields_from_one_row(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, 1, "z"), (1, 1, "y")], "k int, n int, s string")
    assert df.groupBy("k").agg(first_by_key(["n", "s"]).alias("f")).select("f.*").first() == (1, "y")


def test_box_keeps_its_edges(spark):
    (south, north), (west, east) = silver.LAT_RANGE, silver.LNG_RANGE
    inside = [(south, -50.0), (north, -50.0), (0.0, west), (0.0, east)]
    outside = [(south - 1e-8, -50.0), (north + 1e-8, -50.0), (0.0, west - 1e-8), (0.0, east + 1e-8)]
    df = spark.createDataFrame([*inside, *outside, (None, -50.0)], "lat double, lng double")
    assert values(within_box(df, "lat", "lng", silver.LAT_RANGE, silver.LNG_RANGE)) == sorted(inside, key=repr)


def test_round_money(spark):
    df = spark.createDataFrame([(x,) for x in (1.005, 2.675, 0.125, -0.125)], "x double")
    assert [r[0] for r in df.select(round_money("x")).collect()] == [1.01, 2.68, 0.13, -0.13]


def test_sum_money_is_exact_and_independent_of_row_order(spark):
    df = spark.range(100_000).select((F.lit(1) / 10).alias("x"))
    assert df.agg(sum_money("x")).first()[0] == 10_000.0
    assert df.repartition(7).agg(sum_money("x")).first()[0] == 10_000.0


def test_sum_money_of_large_amounts(spark):
    def total(*amounts):
        df = spark.createDataFrame([(x,) for x in amounts], "x double")
        return df.agg(sum_money("x")).first()[0]

    assert total(1.5, 1e14) == 1e14 + 1.5
    assert total(-0.01, -1e15, 1e15, 0.03) == 0.02
    assert total(1.0, math.inf) == math.inf
    assert total(1e18, 1e18, 1.0) == 2e18
    assert total(None, 2.25) == 2.25
    assert total(None) is None
    assert spark.range(20_000).agg(sum_money(F.lit(9.9e12))).first()[0] == 1.98e17
    df = spark.range(7000).select((F.lit(1e13) + F.col("id") / 7).cast("decimal(20,2)").cast("double").alias("x"))
    assert df.agg(sum_money("x")).first() == df.orderBy(F.desc("x")).repartition(7).agg(sum_money("x")).first()


def test_zip_text(spark):
    df = spark.createDataFrame([("01310",), ("1310",), (" 1310 ",), ("0131A",), ("000",), ("1310.0",), (None,)], "z string")
    assert [r[0] for r in df.select(zip_text("z")).collect()] == ["1310", "1310", "1310", "0131A", "0", "1310", None]
    assert spark.range(7, 8).select(zip_text("id")).first()[0] == "7"


def test_amounts_that_are_no_number_go(spark, ansi):
    items = spark.createDataFrame(
        [("a", "1.005", "2"), ("b", "n/a", "2"), ("c", None, "2")], "order_id string, price string, freight_value string"
    )
    assert values(silver.order_items(items)) == [("a", 1.01, 2.0)]
    payments = spark.createDataFrame(
        [("o", 1, "card", "3.9", "5"), ("o", 2, "card", ".5", "10"), ("p", 1, "card", "1.0", "7"), ("q", 1, "card", "1", "n/a")],
        "order_id string, payment_sequential int, payment_type string, payment_installments string, payment_value string",
    )
    assert values(silver.payments(payments)) == [("o", 15.0, 3, "card", 2, 2), ("p", 7.0, 1, "card", 1, 1)]


def test_int_casts(spark, ansi):
    texts = ["5", " 7 ", "+4", "-3.9", "3.9", "3.", "abc", "3.x", "1.2.3", "", "99999999999", None, ".5", "-.5", ".", "+", "-"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(int_from_text("t")).collect()]
    assert got == [5, 7, 4, -3, 3, 3, None, None, None, None, None, None, 0, 0, 0, None, None]
    doubles = spark.createDataFrame([(3.9, "2"), (-3.9, "x"), (NAN, "0"), (1e12, "1")], "d double, s string")
    cast = doubles.withColumns(int_columns(doubles, ["d", "s", "absent"]))
    assert [tuple(r) for r in cast.collect()] == [(3, 2), (-3, None), (None, 0), (None, 1)]


def test_int_casts_against_the_plain_patterns(spark, ansi):
    texts = ["0", "00", " +1.\t", " -.", "5\n", "5.5\u2028", "1 2", "+-1", "007", "-0", "-5", "2147483647", "2147483648", "-2147483648", "+9", "1 ", "1\u00a0", "\x001", "1\x1f", "1e3", "١"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pattern = r"^\s*[+-]?(\d+(\.\d*)?|\.\d*)\s*$"
    digits = F.regexp_extract("t", r"^\s*([+-]?\d+)", 1)
    plain = F.when(F.regexp_like("t", F.lit(pattern)), F.when(digits == "", 0).otherwise(digits.try_cast("int")))
    assert all(r.a == r.b for r in df.select(int_from_text("t").alias("a"), plain.alias("b")).collect())


def test_calendar(spark):
    df = spark.sql("SELECT explode(array(date'2017-01-01', date'2018-12-31', date'2020-02-29')) AS d")
    rows = df.select(date_key("d").alias("k"), *[c.alias(n) for n, c in calendar_columns("d").items()]).collect()
    assert [(r.k, r.quarter, r.day_of_week, r.week_of_year, r.month_name, r.day_name, r.is_weekend) for r in rows] == [
        (20170101, 1, 7, 52, "January", "Sunday", True),
        (20181231, 4, 1, 1, "December", "Monday", False),
        (20200229, 1, 6, 9, "February", "Saturday", True),
    ]


def test_products_made_equal_or_null_by_the_cast_stay(spark):
    df = spark.createDataFrame(
        [("p", 3.2), ("p", 3.7), ("q", 1e12), ("r", None)], "product_id string, product_length_cm double"
    )
    assert values(silver.products(df)) == [("p", 3), ("p", 3), ("q", None)]


def test_order_items_equal_after_rounding_collapse(spark):
    df = spark.createDataFrame(
        [("o", 1.001, 2.0), ("o", 1.002, 2.0), ("o", None, 2.0)],
        "order_id string, price double, freight_value double",
    )
    assert values(silver.order_items(df)) == [("o", 1.0, 2.0)]


def test_payments(spark, ansi):
    df = spark.createDataFrame(
        [("o", 2, "card", "3", 10.005), ("o", 1, "voucher", "1.0", 0.1), ("o", 1, "boleto", "2", 0.2),
         ("o", 9, "card", "bad", 99.0), ("x", 1, None, "1", 5.0)],
        "order_id string, payment_sequential int, payment_type string, payment_installments string,"
        " payment_value double",
    )
    out = silver.payments(df)
    assert out.columns == [
        "order_id", "payment_value", "payment_installments", "payment_type", "payment_sequential", "num_payments",
    ]
    assert values(out) == [("o", 10.31, 3, "boleto", 2, 3)]


def test_order_reviews(spark, ansi):
    df = spark.createDataFrame(
        [("r2", "o", "5", None, "late"), ("r1", "o", "3.9", "t", "ok"), ("r0", "o", "abc", None, "bad score"),
         ("r3", "p", "4", None, None)],
        "review_id string, order_id string, review_score string, review_comment_title string,"
        " review_comment_message string",
    )
    assert values(silver.order_reviews(df)) == [("o", "r1", 3, "ok", 2)]
    without_title = df.drop("review_comment_title")
    assert values(silver.order_reviews(without_title)) == [("o", "r1", 3, "ok", 2)]


def test_orders_with_a_missing_field_are_lost_but_keep_their_date(spark):
    df = spark.createDataFrame(
        [("a", "c", "2020-01-01 10:00:00", "x"), ("a", "b", "2020-01-02 10:00:00", "x"),
         ("z", "c", "2021-01-01 00:00:00", None)],
        "order_id string, customer_id string, order_purchase_timestamp string, delivered string",
    ).withColumn("order_purchase_timestamp", F.col("order_purchase_timestamp").cast("timestamp_ntz"))
    assert [r.customer_id for r in silver.orders(df).collect()] == ["b"]
    assert silver.date(df).count() == 3

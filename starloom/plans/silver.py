"""Silver: one cleaning step per table, each a function of the bronze table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.casts import double_columns, int_columns
from starloom.functions.money import round_money, sum_money
from starloom.operators.cleaning import (
    dedupe_by_key,
    distinct_rows,
    drop_nulls,
    first_by_key,
    within_box,
)
from starloom.operators.joins import count_hot_keys

# The bounding box of the coordinates, and the columns made whole numbers.
LAT_RANGE = (-33.75116944, 5.27438888)
LNG_RANGE = (-73.98283055, -34.79314722)
MONEY_COLUMNS = ("price", "freight_value")
PRODUCT_INT_COLUMNS = (
    "product_description_length",
    "product_length_cm",
    "product_height_cm",
    "product_width_cm",
)


def customers(bronze: DataFrame) -> DataFrame:
    """Distinct complete rows."""
    return distinct_rows(drop_nulls(bronze))


def sellers(bronze: DataFrame) -> DataFrame:
    """One complete row per seller."""
    return dedupe_by_key(drop_nulls(bronze), ["seller_id"])


def products(bronze: DataFrame) -> DataFrame:
    """Distinct complete rows, then lengths and sizes as whole numbers.

    Rows that only become equal, or null, through the cast stay.
    """
    df = distinct_rows(drop_nulls(bronze))
    return df.withColumns(int_columns(df, PRODUCT_INT_COLUMNS))


def order_items(bronze: DataFrame) -> DataFrame:
    """Distinct complete rows, with money to the cent.

    Amounts that are no number become null and go. Rounding a number makes no null, so the null
    check can come before it.
    """
    numbers = bronze.withColumns(double_columns(bronze, MONEY_COLUMNS))
    return distinct_rows(drop_nulls(numbers).withColumns({c: round_money(c) for c in MONEY_COLUMNS}))


def payments(bronze: DataFrame) -> DataFrame:
    """One row per order; the payment type is that of the lowest payment number."""
    numbers = int_columns(bronze, ["payment_installments"]) | double_columns(bronze, ["payment_value"])
    df = drop_nulls(bronze.withColumns(numbers))
    per_order = df.withColumn("payment_value", round_money("payment_value")).groupBy("order_id").agg(
        sum_money("payment_value").alias("payment_value"),
        F.max("payment_installments").alias("payment_installments"),
        first_by_key(["payment_sequential", "payment_type"]).alias("first"),
        F.max("payment_sequential").alias("payment_sequential"),
        F.count("*").alias("num_payments"),
    )
    return per_order.select(
        "order_id",
        "payment_value",
        "payment_installments",
        "first.payment_type",
        "payment_sequential",
        "num_payments",
    )


def order_reviews(bronze: DataFrame) -> DataFrame:
    """One row per order, from its review of lowest id; reviews without a message are dropped."""
    df = bronze.withColumns(int_columns(bronze, ["review_score"])).drop("review_comment_title")
    per_order = drop_nulls(df).groupBy("order_id").agg(
        first_by_key(["review_id", "review_score", "review_comment_message"]).alias("first"),
        F.count("*").alias("num_reviews"),
    )
    return per_order.select("order_id", "first.*", "num_reviews")


def product_category(bronze: DataFrame) -> DataFrame:
    """Distinct complete rows."""
    return distinct_rows(drop_nulls(bronze))


def orders(bronze: DataFrame) -> DataFrame:
    """One complete row per order."""
    return dedupe_by_key(drop_nulls(bronze), ["order_id"])


def date(bronze_orders: DataFrame) -> DataFrame:
    """Distinct purchase times of all orders, complete or not."""
    return distinct_rows(drop_nulls(bronze_orders.select("order_purchase_timestamp")))


def geolocation(bronze: DataFrame) -> DataFrame:
    """Distinct complete rows inside the box."""
    return within_box(
        distinct_rows(drop_nulls(bronze)), "geolocation_lat", "geolocation_lng", LAT_RANGE, LNG_RANGE
    )


# Silver table -> (builder, source it reads), in load order.
TABLES = {
    "customers": (customers, "customers"),
    "sellers": (sellers, "sellers"),
    "products": (products, "products"),
    "order_items": (order_items, "order_items"),
    "payments": (payments, "payments"),
    "order_reviews": (order_reviews, "order_reviews"),
    "product_category": (product_category, "product_category"),
    "orders": (orders, "orders"),
    "date": (date, "orders"),
    "geolocation": (geolocation, "geolocation"),
}


def hot_keys(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Keys that a large share of the items or orders has, for the joins of the fact; empty on most data.

    One pass over the three keys of the items and one over the customers of the orders; one more where a key may be hot.
    """
    of_items = count_hot_keys(order_items, ["order_id", "product_id", "seller_id"])
    return of_items.union(count_hot_keys(orders, ["customer_id"]))


ONE_ROW_PER_ORDER = ("orders", "payments", "order_reviews")

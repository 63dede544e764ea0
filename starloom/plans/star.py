"""Star queries on the gold tables.

The fact is first summed per dimension key, in each task before anything is shuffled, and only
those sums meet the dimension. So neither a hot key nor a large dimension moves fact rows. The sums are
dealt by key already, so a dimension that grows with the data is dealt alike, never broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.money import sum_money
from starloom.operators.joins import shuffled


def revenue_by_month(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    daily = fact.groupBy("date_key").agg(
        sum_money("price").alias("revenue"), F.count("*").alias("items")
    )
    return (
        daily.join(dim_date.select("date_key", "year", "month", "month_name"), "date_key")
        .groupBy("year", "month", "month_name")
        .agg(sum_money("revenue").alias("revenue"), F.sum("items").alias("items"))
    )


def revenue_by_category(fact: DataFrame, dim_product: DataFrame) -> DataFrame:
    per_product = fact.groupBy("product_id").agg(
        sum_money("price").alias("revenue"), F.count("*").alias("items")
    )
    category = F.col("product_category_name_english").alias("category")
    return (
        per_product.join(shuffled(dim_product.select("product_id", category)), "product_id")
        .groupBy("category")
        .agg(sum_money("revenue").alias("revenue"), F.sum("items").alias("items"))
    )


def revenue_by_payment_type(fact: DataFrame, dim_order: DataFrame) -> DataFrame:
    per_order = fact.groupBy("order_id").agg(sum_money("price").alias("revenue"))
    return (
        per_order.join(shuffled(dim_order.select("order_id", "payment_type")), "order_id")
        .groupBy("payment_type")
        .agg(sum_money("revenue").alias("revenue"), F.count("*").alias("orders"))
    )


def revenue_by_customer_city(fact: DataFrame, dim_customer: DataFrame) -> DataFrame:
    per_customer = fact.groupBy("customer_id").agg(sum_money("price").alias("revenue"))
    return (
        per_customer.join(shuffled(dim_customer.select("customer_id", "customer_city")), "customer_id")
        .groupBy("customer_city")
        .agg(sum_money("revenue").alias("revenue"), F.count("*").alias("customers"))
    )


def freight_by_seller_city(fact: DataFrame, dim_seller: DataFrame) -> DataFrame:
    per_seller = fact.groupBy("seller_id").agg(sum_money("freight_value").alias("freight"))
    return (
        per_seller.join(shuffled(dim_seller.select("seller_id", "seller_city")), "seller_id")
        .groupBy("seller_city")
        .agg(sum_money("freight").alias("freight"), F.count("*").alias("sellers"))
    )


def avg_score_by_category(
    fact: DataFrame, dim_review: DataFrame, dim_product: DataFrame
) -> DataFrame:
    """Average score over the items sold; a review id counts with one (its lowest) score."""
    per_pair = fact.groupBy("review_id", "product_id").agg(F.count("*").alias("items"))
    score = dim_review.groupBy("review_id").agg(F.min("review_score").alias("review_score"))
    # a review has one row per product here, however many items it has
    per_product = (
        per_pair.join(shuffled(score), "review_id")
        .groupBy("product_id")
        .agg(
            F.sum(F.col("review_score") * F.col("items")).alias("scores"),
            F.sum("items").alias("items"),
        )
    )
    category = F.col("product_category_name_english").alias("category")
    return (
        per_product.join(shuffled(dim_product.select("product_id", category)), "product_id")
        .groupBy("category")
        .agg((F.sum("scores") / F.sum("items")).alias("avg_score"), F.sum("items").alias("items"))
    )


def weekend_split(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    daily = fact.groupBy("date_key").agg(
        sum_money("price").alias("revenue"), F.count("*").alias("items")
    )
    return (
        daily.join(dim_date.select("date_key", "is_weekend"), "date_key")
        .groupBy("is_weekend")
        .agg(sum_money("revenue").alias("revenue"), F.sum("items").alias("items"))
    )


def payment_total_per_month(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Payments at the grain of the order; the fact repeats them on each of its items."""
    per_order = fact.groupBy("order_id").agg(
        F.max("date_key").alias("date_key"), F.max("payment_value").alias("payment_value")
    )
    daily = per_order.groupBy("date_key").agg(
        sum_money("payment_value").alias("payments"), F.count("*").alias("orders")
    )
    return (
        daily.join(dim_date.select("date_key", "year", "month"), "date_key")
        .groupBy("year", "month")
        .agg(sum_money("payments").alias("payments"), F.sum("orders").alias("orders"))
    )

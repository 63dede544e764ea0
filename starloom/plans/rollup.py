"""Roll-ups of the fact, kept by the load, and the star queries answered from them.

Sums add up from any finer grain, and money sums are exact at each (`sum_money`), so queries on a roll-up give what
they give on the fact. Counts of different things add up only where each thing falls into one group:

* an order has one day and one payment type, so orders and payments are counted per (day, payment type);
* a seller or a customer has many days: they are counted as the different keys of a roll-up that has one row, or a
  few, for each.

Each roll-up is built anew with the fact. No side of a join is broadcast: all but the days grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.money import sum_money
from starloom.operators.joins import join_many_to_one, shuffled


def sales_rollup(fact: DataFrame, dim_order: DataFrame) -> DataFrame:
    """Revenue, freight and items by day, product, seller and payment type.

    The fact is summed per order before it meets the orders; an order's items of one product and seller are one row.
    """
    grain = ["date_key", "product_id", "seller_id"]
    per_order = fact.groupBy("order_id", *grain).agg(*_sums("price", "freight_value", F.count("*")))
    typed = join_many_to_one(per_order, shuffled(dim_order.select("order_id", "payment_type")), "order_id")
    return typed.groupBy(*grain, "payment_type").agg(*_sums("revenue", "freight", F.sum("items")))


def order_rollup(fact: DataFrame, dim_order: DataFrame) -> DataFrame:
    """Orders and their payments by day and payment type."""
    per_order = fact.groupBy("order_id").agg(
        F.max("date_key").alias("date_key"), F.max("payment_value").alias("payment_value")
    )
    typed = join_many_to_one(per_order, shuffled(dim_order.select("order_id", "payment_type")), "order_id")
    return typed.groupBy("date_key", "payment_type").agg(
        sum_money("payment_value").alias("payments"), F.count("*").alias("orders")
    )


def customer_rollup(fact: DataFrame) -> DataFrame:
    """Revenue and items by customer."""
    return fact.groupBy("customer_id").agg(sum_money("price").alias("revenue"), F.count("*").alias("items"))


def score_rollup(fact: DataFrame, dim_review: DataFrame) -> DataFrame:
    """The sum of the scores of the items sold, and the items, by product. A review id counts with its lowest score."""
    per_pair = fact.groupBy("review_id", "product_id").agg(F.count("*").alias("items"))
    score = dim_review.groupBy("review_id").agg(F.min("review_score").alias("review_score"))
    return per_pair.join(shuffled(score), "review_id").groupBy("product_id").agg(
        F.sum(F.col("review_score") * F.col("items")).alias("scores"), F.sum("items").alias("items")
    )


def _sums(revenue: str, freight: str, items: Column) -> list[Column]:
    return [sum_money(revenue).alias("revenue"), sum_money(freight).alias("freight"), items.alias("items")]


MONEY = ("revenue", "freight", "payments")

# Table -> (builder, gold tables it reads).
TABLES = {
    "sales_rollup": (sales_rollup, ["fact_sales", "dim_order"]),
    "order_rollup": (order_rollup, ["fact_sales", "dim_order"]),
    "customer_rollup": (customer_rollup, ["fact_sales"]),
    "score_rollup": (score_rollup, ["fact_sales", "dim_review"]),
}


# ---- the queries of `star`, from roll-ups


def _by(rollup: DataFrame, key: str, dimension: DataFrame, groups: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sum a roll-up per dimension key, look the groups up, and sum again."""
    per_key = rollup.groupBy(key).agg(*[c.alias(n) for n, c in sums.items()])
    again = {n: sum_money(n) if n in MONEY else F.sum(n) for n in sums}
    joined = per_key.join(shuffled(dimension.select(key, *groups)), key)
    return joined.groupBy(*groups).agg(*[c.alias(n) for n, c in again.items()])


def _revenue_and_items() -> dict[str, Column]:
    return {"revenue": sum_money("revenue"), "items": F.sum("items")}


def _with_category(dim_product: DataFrame) -> DataFrame:
    return dim_product.select("product_id", F.col("product_category_name_english").alias("category"))


def revenue_by_month(sales: DataFrame, dim_date: DataFrame) -> DataFrame:
    return _by(sales, "date_key", dim_date, ["year", "month", "month_name"], _revenue_and_items())


def weekend_split(sales: DataFrame, dim_date: DataFrame) -> DataFrame:
    return _by(sales, "date_key", dim_date, ["is_weekend"], _revenue_and_items())


def revenue_by_category(sales: DataFrame, dim_product: DataFrame) -> DataFrame:
    return _by(sales, "product_id", _with_category(dim_product), ["category"], _revenue_and_items())


def revenue_by_payment_type(sales: DataFrame, orders: DataFrame) -> DataFrame:
    revenue = sales.groupBy("payment_type").agg(sum_money("revenue").alias("revenue"))
    return revenue.join(orders.groupBy("payment_type").agg(F.sum("orders").alias("orders")), "payment_type")


def freight_by_seller_city(sales: DataFrame, dim_seller: DataFrame) -> DataFrame:
    sums = {"freight": sum_money("freight"), "sellers": F.lit(1)}  # one row per seller after the first sum
    return _by(sales, "seller_id", dim_seller, ["seller_city"], sums)


def revenue_by_customer_city(customers: DataFrame, dim_customer: DataFrame) -> DataFrame:
    city = shuffled(dim_customer.select("customer_id", "customer_city"))
    per_city = customers.join(city, "customer_id").groupBy("customer_city")
    return per_city.agg(sum_money("revenue").alias("revenue"), F.count("*").alias("customers"))


def avg_score_by_category(scores: DataFrame, dim_product: DataFrame) -> DataFrame:
    per_category = scores.join(shuffled(_with_category(dim_product)), "product_id").groupBy("category")
    return per_category.agg((F.sum("scores") / F.sum("items")).alias("avg_score"), F.sum("items").alias("items"))


def payment_total_per_month(orders: DataFrame, dim_date: DataFrame) -> DataFrame:
    return _by(orders, "date_key", dim_date, ["year", "month"], {"payments": sum_money("payments"), "orders": F.sum("orders")})

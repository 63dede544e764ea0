"""Gold: six dimensions and the order-item sales fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.calendar import calendar_columns
from starloom.functions.casts import zip_text
from starloom.operators.cleaning import dedupe_by_key
from starloom.operators.joins import HotKeys, by_rows, join_many_to_one, shuffled


def dim_order(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """One row per paid order."""
    return orders.select("order_id", "order_status").join(
        shuffled(payments.select("order_id", "payment_type")), "order_id"
    )


def dim_customer(customers: DataFrame, geolocation: DataFrame) -> DataFrame:
    """One row per customer, with a coordinate of its zip prefix where there is one.

    Each zip prefix is brought down to one point before the join, so the join adds no rows. Zips are
    compared as text without zeros in front, so that either side may hold numbers or text.
    """
    points = geolocation.select(
        zip_text("geolocation_zip_code_prefix").alias("_zip"),
        F.col("geolocation_lat").alias("customer_lat"),
        F.col("geolocation_lng").alias("customer_lng"),
    )
    point = dedupe_by_key(points, ["_zip"])
    keyed = customers.withColumn("_zip", zip_text("customer_zip_code_prefix"))
    located = join_many_to_one(keyed, point, "_zip", "left", null_keys=False)
    return dedupe_by_key(located.drop("_zip", "customer_zip_code_prefix"), ["customer_id"])


def dim_seller(sellers: DataFrame) -> DataFrame:
    """The cleaned sellers as they are."""
    return sellers


def dim_product(products: DataFrame, product_category: DataFrame) -> DataFrame:
    """Products whose category has a translation."""
    english = product_category.select("product_category_name", "product_category_name_english")
    return join_many_to_one(products, english, "product_category_name").select(
        "product_id",
        "product_category_name",
        "product_category_name_english",
        "product_name_length",
        "product_description_length",
        "product_photos_qty",
        "product_weight_g",
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
    )


def dim_review(order_reviews: DataFrame) -> DataFrame:
    """Review scores, one row per reviewed order; a review id may repeat."""
    return order_reviews.select("review_id", "review_score")


def dim_date(date: DataFrame) -> DataFrame:
    """One row per day from the first to the last purchase."""
    first_last = date.agg(
        F.min("order_purchase_timestamp").cast("date").alias("first"),
        F.max("order_purchase_timestamp").cast("date").alias("last"),
    )
    days = F.sequence("first", "last", F.expr("INTERVAL 1 DAY"))
    return first_last.select(F.explode(days).alias("date")).withColumns(calendar_columns("date"))


#: The fact takes these columns of an item's order, and of the item.
PLACED = ("customer_id", "review_id", "date_key", "payment_value", "payment_installments", "payment_sequential")
SOLD = ("order_item_id", "product_id", "seller_id", "price", "freight_value")
FACT_COLUMNS = (
    "order_id",
    "order_item_id",
    "customer_id",
    "product_id",
    "seller_id",
    "review_id",
    "date_key",
    "price",
    "freight_value",
    "payment_value",
    "payment_installments",
    "payment_sequential",
)


def fact_sales(
    orders: DataFrame,
    order_items: DataFrame,
    payments: DataFrame,
    order_reviews: DataFrame,
    dim_customer: DataFrame,
    dim_product: DataFrame,
    dim_seller: DataFrame,
    dim_date: DataFrame,
    hot_keys: DataFrame | None = None,
) -> DataFrame:
    """One row per item of an order that is paid, reviewed and known in every dimension.

    Customers and sellers are unique by key and give no column, so they only filter. The order
    dimension would filter nothing more than the join with payments does. Orders, payments and
    reviews, all one row per order, are joined first on one partitioning (none has to be shuffled
    where the tables are bucketed). The items meet these next, as that join keeps the fewest of them: products
    and sellers are looked up for those left. Whatever the size of their files, only the days and dimensions of few
    rows, which are counted at once, may be broadcast.

    `hot_keys` is the silver table of that name: keys that are to be spread (`joins.HotKeys`).
    """
    hot = HotKeys.of(hot_keys) if hot_keys is not None else {}
    placed = (
        orders.select(
            "order_id", "customer_id", F.col("order_purchase_timestamp").cast("date").alias("date")
        )
        .join(shuffled(order_reviews.select("order_id", "review_id")), "order_id")
        .join(
            shuffled(payments.select("order_id", "payment_value", "payment_installments", "payment_sequential")),
            "order_id",
        )
    )
    placed = join_many_to_one(
        placed, by_rows(dim_customer.select("customer_id")), "customer_id", "left_semi", hot.get("customer_id")
    )
    placed = placed.join(dim_date.select("date", "date_key"), "date").select("order_id", *PLACED)
    sold = order_items.select("order_id", *SOLD)
    sold = join_many_to_one(sold, shuffled(placed), "order_id", "inner", hot.get("order_id"))
    sold = join_many_to_one(
        sold, by_rows(dim_product.select("product_id")), "product_id", "inner", hot.get("product_id")
    )
    sold = join_many_to_one(
        sold, by_rows(dim_seller.select("seller_id")), "seller_id", "left_semi", hot.get("seller_id")
    )
    return sold.select(*FACT_COLUMNS)


def fact_sales_attrition(
    orders: DataFrame,
    order_items: DataFrame,
    payments: DataFrame,
    order_reviews: DataFrame,
    dim_customer: DataFrame,
    dim_product: DataFrame,
    dim_seller: DataFrame,
    dim_date: DataFrame,
) -> DataFrame:
    """Items that each join of the fact loses, in order: step, rows before and after it, lost.

    One pass over the items, with a flag for each side found. An item counts as lost at the first
    step that does not find it. A product of several rows counts an item once.
    """

    def flag(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(key).distinct().withColumn(name, F.lit(True))

    placed = (
        orders.select("order_id", "customer_id", F.col("order_purchase_timestamp").cast("date").alias("date"))
        .withColumn("order", F.lit(True))
        .join(flag(payments, "order_id", "payment"), "order_id", "left")
        .join(flag(order_reviews, "order_id", "review"), "order_id", "left")
        .join(flag(dim_customer, "customer_id", "customer"), "customer_id", "left")
        .join(flag(dim_date, "date", "day"), "date", "left")
        .drop("customer_id", "date")
    )
    flagged = (
        order_items.select("order_id", "product_id", "seller_id")
        .join(placed, "order_id", "left")
        .join(flag(dim_product, "product_id", "product"), "product_id", "left")
        .join(flag(dim_seller, "seller_id", "seller"), "seller_id", "left")
    )
    steps = ("order", "payment", "review", "customer", "day", "product", "seller")
    counts, kept = [F.count("*").alias("n0")], F.lit(True)
    for i, step in enumerate(steps, 1):
        kept = kept & F.coalesce(step, F.lit(False))
        counts.append(F.count(F.when(kept, 1)).alias(f"n{i}"))
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(step).alias("step"),
            F.col(f"n{i - 1}").alias("rows_before"),
            F.col(f"n{i}").alias("rows_after"),
            (F.col(f"n{i - 1}") - F.col(f"n{i}")).alias("lost"),
        )
        for i, step in enumerate(steps, 1)
    ]
    return flagged.agg(*counts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# Gold table -> (builder, tables it reads as (layer, table)), in load order.
TABLES = {
    "dim_order": (dim_order, [("silver", "orders"), ("silver", "payments")]),
    "dim_customer": (dim_customer, [("silver", "customers"), ("silver", "geolocation")]),
    "dim_seller": (dim_seller, [("silver", "sellers")]),
    "dim_product": (dim_product, [("silver", "products"), ("silver", "product_category")]),
    "dim_review": (dim_review, [("silver", "order_reviews")]),
    "dim_date": (dim_date, [("silver", "date")]),
    "fact_sales": (
        fact_sales,
        [
            ("silver", "orders"),
            ("silver", "order_items"),
            ("silver", "payments"),
            ("silver", "order_reviews"),
            ("gold", "dim_customer"),
            ("gold", "dim_product"),
            ("gold", "dim_seller"),
            ("gold", "dim_date"),
            ("silver", "hot_keys"),
        ],
    ),
}

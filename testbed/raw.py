"""The nine source tables as projections of the given tables, with nulls and copies planted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_schemas: dict[str, StructType] = {}


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table; its schema is read from the file once."""
    path = f"{sf_dir}/{table}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS customer_id",
        "c_nationkey AS customer_zip_code_prefix",
        "nullif(c_mktsegment, 'MACHINERY') AS customer_city",
    )
    return rows.unionAll(rows.filter("customer_id % 10 = 0"))


def sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = given(spark, sf_dir, "supplier")
    rows = supplier.selectExpr(
        "s_suppkey AS seller_id",
        "s_nationkey AS seller_zip_code_prefix",
        "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS seller_city",
    )
    again = supplier.filter("s_suppkey % 5 = 0").selectExpr(
        "s_suppkey", "s_nationkey + 1", "concat(s_name, '#dup')"
    )
    return rows.unionAll(again)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id",
        "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS product_category_name",
        "length(p_name) AS product_name_length",
        "p_retailprice AS product_description_length",
        "p_size AS product_photos_qty",
        "p_retailprice AS product_weight_g",
        "p_size + 0.7D AS product_length_cm",
        "p_size + 1.7D AS product_height_cm",
        "p_size + 2.7D AS product_width_cm",
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS customer_id",
        "o_orderstatus AS order_status",
        "o_orderdate AS order_purchase_timestamp",
        "nullif(o_orderpriority, '5-LOW') AS order_note",
    )
    later = rows.filter("order_id % 100 = 0 AND order_note IS NOT NULL").withColumn(
        "order_purchase_timestamp", F.expr("order_purchase_timestamp + INTERVAL 1 DAY")
    )
    return rows.unionAll(later)


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = given(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS order_id",
        "l_linenumber AS order_item_id",
        "l_partkey AS product_id",
        "l_suppkey AS seller_id",
        "l_extendedprice AS price",
        # exact product of two amounts of two decimal places
        "rint(l_extendedprice * 100) * rint(l_tax * 100) / 10000D AS freight_value",
    )
    return rows.unionAll(rows.filter("order_id % 50 = 0"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS order_id",
        "l_linenumber AS payment_sequential",
        "CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_returnflag END AS payment_type",
        "cast(l_quantity AS int) AS payment_installments",
        "l_extendedprice AS payment_value",
    )


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "events").selectExpr(
        "event_id AS review_id",
        "event_id div 2 AS order_id",
        "CASE WHEN event_id % 41 = 0 THEN 'bad'"
        " ELSE cast(cast(get_json_object(props, '$.k') AS int) % 5 + 1 AS string) END AS review_score",
        "cast(NULL AS string) AS review_comment_title",
        "nullif(event_type, 'error') AS review_comment_message",
    )


def product_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        given(spark, sf_dir, "part")
        .filter("p_type <> 'ECONOMY'")
        .selectExpr(
            "p_type AS product_category_name",
            "concat(lower(p_type), '_en') AS product_category_name_english",
        )
        .distinct()
    )


def geolocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = given(spark, sf_dir, "supplier")
    rows = supplier.unionAll(supplier.filter("s_suppkey % 4 = 0"))
    return rows.selectExpr(
        "s_nationkey AS geolocation_zip_code_prefix",
        "s_acctbal / 250.0D - 35.0D AS geolocation_lat",
        "-s_acctbal / 200.0D - 30.0D AS geolocation_lng",
        "s_name AS geolocation_city",
        "'XX' AS geolocation_state",
    )


RAW: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "customers": customers,
    "sellers": sellers,
    "products": products,
    "orders": orders,
    "order_items": order_items,
    "payments": payments,
    "order_reviews": order_reviews,
    "product_category": product_category,
    "geolocation": geolocation,
}

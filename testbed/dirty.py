"""Source tables as text, with values planted that are not of their columns' types."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.plans import bronze, gold, silver
from starloom.sources.tables import Lakehouse
from testbed.lake import new_lakehouse, write_csv
from testbed.raw import RAW

#: A column's value -> what the file holds instead.
PLANTED = {
    "payments": {
        "payment_installments": "CASE WHEN order_id % 13 = 0 THEN concat(payment_installments, '.9')"
        " WHEN order_id % 17 = 0 THEN concat(payment_installments, '.0')"
        " WHEN order_id % 19 = 0 THEN 'n/a' ELSE cast(payment_installments AS string) END",
        "payment_value": "CASE WHEN payment_sequential = 7 THEN 'n/a' ELSE cast(payment_value AS string) END",
    },
    "order_items": {
        "price": "CASE WHEN product_id % 29 = 0 THEN 'n/a' ELSE cast(price AS string) END",
    },
    "customers": {
        "customer_zip_code_prefix": "CASE WHEN customer_id % 11 = 0 THEN concat(customer_zip_code_prefix, 'A')"
        " WHEN customer_id % 3 = 0 THEN concat('00', customer_zip_code_prefix)"
        " ELSE cast(customer_zip_code_prefix AS string) END",
    },
    "geolocation": {},
}


def ingested(spark: SparkSession, sf_dir: str, name: str, infer: bool) -> tuple[Lakehouse, DataFrame, dict[str, Any]]:
    """One source through a CSV file, with the library's own types or inferred ones."""
    mode = "inferred" if infer else "declared"
    lake = new_lakehouse(spark, f"dirty_{name}_{mode}", sf_dir)
    lake.create_layer("bronze")
    raw = RAW[name](spark, sf_dir)
    text = raw.select(*[F.expr(PLANTED[name].get(c, c)).alias(c) for c in raw.columns])
    write_csv(text, f"{lake.location}/csv/{bronze.SOURCES[name].table}.csv")
    record = bronze.ingest(lake, name, f"{lake.location}/csv", infer_schema=infer)
    return lake, lake.read("bronze", bronze.SOURCES[name].table), record


def _both(build: Callable[[bool], DataFrame]) -> DataFrame:
    """With declared and with inferred types, `mode` telling which; ids as numbers."""
    frames = []
    for infer in (False, True):
        df = build(infer)
        ids = {c: F.col(c).cast("long") for c in df.columns if c.endswith("_id") and c != "order_item_id"}
        frames.append(df.withColumns(ids).withColumn("mode", F.lit("inferred" if infer else "declared")))
    return reduce(DataFrame.unionByName, frames)


def bronze_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table with declared types, and the number of rejected values from its load record."""
    _, table, record = ingested(spark, sf_dir, "payments", infer=False)
    return table.withColumn("rejected_values", F.lit(record["rejected"]["payment_value"]).cast("long"))


def bronze_payments_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of its rejected values; of the file's name, whether it is there."""
    lake, _, _ = ingested(spark, sf_dir, "payments", infer=False)
    rows = lake.read("bronze", bronze.SOURCES["payments"].table + bronze.REJECTED)
    return rows.withColumn("file", F.col("file").contains(bronze.SOURCES["payments"].table))


def silver_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(lambda infer: silver.payments(ingested(spark, sf_dir, "payments", infer)[1]))


def silver_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(lambda infer: silver.order_items(ingested(spark, sf_dir, "order_items", infer)[1]))


def dim_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(infer: bool) -> DataFrame:
        customers = silver.customers(ingested(spark, sf_dir, "customers", infer)[1])
        points = silver.geolocation(ingested(spark, sf_dir, "geolocation", infer)[1])
        return gold.dim_customer(customers, points)

    return _both(build)

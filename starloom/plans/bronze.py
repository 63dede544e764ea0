"""Bronze: the nine source files as tables named after the files."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.casts import typed_columns
from starloom.sources.csv_files import infer_csv, table_name_of, text_csv
from starloom.sources.tables import Lakehouse

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class Source:
    """A source file `<table>.csv`: the types of its columns and the columns later layers need.

    Columns without a type here are kept as text: also those that silver or gold casts or compares
    by their digits (review score, installments, zip prefixes). Whole numbers may be
    written with decimals. A value that is not of its type becomes null, and the load record has the
    number of these for each column.
    """

    table: str
    types: Mapping[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    multiline: bool = False


# File names, column names and column types of the sources.
SOURCES = {
    "customers": Source(
        "olist_customers_dataset",
        {},
        ("customer_id", "customer_zip_code_prefix", "customer_city"),
    ),
    "sellers": Source(
        "olist_sellers_dataset",
        {},
        ("seller_id", "seller_city"),
    ),
    "products": Source(
        "olist_products_dataset",
        {
            "product_name_length": "int",
            "product_description_length": "double",
            "product_photos_qty": "int",
            "product_weight_g": "double",
            "product_length_cm": "double",
            "product_height_cm": "double",
            "product_width_cm": "double",
        },
        (
            "product_id",
            "product_category_name",
            "product_name_length",
            "product_description_length",
            "product_photos_qty",
            "product_weight_g",
            "product_length_cm",
            "product_height_cm",
            "product_width_cm",
        ),
    ),
    "orders": Source(
        "olist_orders_dataset",
        {"order_purchase_timestamp": "timestamp_ntz"},
        ("order_id", "customer_id", "order_status", "order_purchase_timestamp"),
    ),
    "order_items": Source(
        "olist_order_items_dataset",
        {"order_item_id": "int", "price": "double", "freight_value": "double"},
        ("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value"),
    ),
    "payments": Source(
        "olist_order_payments_dataset",
        {"payment_sequential": "int", "payment_value": "double"},
        ("order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"),
    ),
    "order_reviews": Source(
        "olist_order_reviews_dataset",
        {},
        ("review_id", "order_id", "review_score", "review_comment_message"),
        multiline=True,
    ),
    "product_category": Source(
        "product_category_name_translation",
        {},
        ("product_category_name", "product_category_name_english"),
    ),
    "geolocation": Source(
        "olist_geolocation_dataset",
        {
            "geolocation_lat": "double",
            "geolocation_lng": "double",
        },
        (
            "geolocation_zip_code_prefix",
            "geolocation_lat",
            "geolocation_lng",
            "geolocation_city",
            "geolocation_state",
        ),
    ),
}


#: Added to a table's name: the table of the values that were not of their column's type.
REJECTED = "__rejected"


def rejected_values(text: DataFrame, types: Mapping[str, str], file: bool = True) -> DataFrame:
    """The values of `text` (all columns as text) that are not of their column's type: column, value, reason, row (the
    whole row as CSV), file (null if `text` does not come straight from files)."""
    typed = typed_columns(types, text.columns)
    found = [
        F.when(
            F.col(f"`{c}`").isNotNull() & typed[c].isNull(),
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value"), F.lit(f"not of type {types[c]}").alias("reason")),
        )
        for c in text.columns
        if types.get(c, "string") != "string"
    ]
    if not found:
        return text.sparkSession.createDataFrame([], "column string, value string, reason string, row string, file string")
    name = F.col("_metadata.file_path") if file else F.lit(None).cast("string")
    row = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in text.columns]))
    # most rows have none: they go before anything is made of the rest
    text = text.filter(reduce(Column.__or__, [f.isNotNull() for f in found]))
    each = text.select(row.alias("row"), name.alias("file"), F.explode(F.array_compact(F.array(*found))).alias("r"))
    return each.select("r.column", "r.value", "r.reason", "row", "file")


def ingest_csv(
    lake: Lakehouse,
    path: str,
    types: Mapping[str, str] | None = None,
    required: tuple[str, ...] = (),
    multiline: bool = False,
    infer_schema: bool = False,
    files: Sequence[str] | None = None,
    add: bool = False,
    note: Callable[[str], None] | None = None,
) -> dict[str, Any]:
    """Replace the bronze table named after the file by the file's rows, or with `add` add them to it.

    `files`: of a folder `path`, these files alone. `note`: as in `Lakehouse.write`. The load record's
    `rejected` counts the values of each typed column that were not of its type. If there are any, the files are
    read once more and these values kept in a table beside, of the same name with `REJECTED`.
    """
    load = lake.append if add else lake.write
    if infer_schema:
        return load("bronze", table_name_of(path), infer_csv(lake.spark, files or path, required, multiline), note=note)
    text = text_csv(lake.spark, files or path, required, multiline)
    typed = typed_columns(types or {}, text.columns)
    # values are cast once, in compiled code; what is counted while writing is evaluated row by row by the interpreter
    marks = {c: f"_rejected {i}" for i, c in enumerate(text.columns) if (types or {}).get(c, "string") != "string"}
    marked = text.select(
        *[v.alias(c) for c, v in typed.items()],
        *[F.when(F.col(f"`{c}`").isNotNull() & typed[c].isNull(), 1).alias(mark) for c, mark in marks.items()],
    )
    rejected = {c: F.count(F.col(f"`{mark}`")) for c, mark in marks.items()}
    columns = [F.col(f"`{c}`") for c in text.columns]
    record = load("bronze", table_name_of(path), marked, count=rejected, then=columns, note=note)
    for column, n in record["rejected"].items():
        if n:
            logger.warning("%s: %d values of %s are not of type %s", path, n, column, types[column])
    beside = table_name_of(path) + REJECTED
    if any(record["rejected"].values()):
        load("bronze", beside, rejected_values(text, types, file=not multiline))
    elif not add and lake.spark.catalog.tableExists(lake.table_name("bronze", beside)):
        lake.write("bronze", beside, lake.read("bronze", beside).limit(0))  # of an earlier load
    return record


def ingest(
    lake: Lakehouse,
    name: str,
    source_dir: str,
    types: Mapping[str, str] | None = None,
    infer_schema: bool = False,
    **how: Any,
) -> dict[str, Any]:
    """Ingest one of `SOURCES` from `source_dir`; `types` overrides its column types. `how`: more of `ingest_csv`."""
    source = SOURCES[name]
    return ingest_csv(
        lake,
        f"{source_dir.rstrip('/')}/{source.table}.csv",
        {**source.types, **(types or {})},
        source.required,
        source.multiline,
        infer_schema,
        **how,
    )

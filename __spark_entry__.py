"""

Primitives and silver cleaners run lazily from the given tables. Like the load jobs, gold builders
read the written silver (the fact: also gold) tables and star queries the written gold tables. The
lakehouse they share is loaded from CSV into the folder of `spark.checkpoint.dir`, once per
application and input folder. `fact_sales_clustered` and `answer_third_page` load silver and gold of
their own from the given tables.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from starloom.functions.calendar import calendar_columns, date_key  # noqa: E402
from starloom.functions.casts import int_columns, int_from_text, typed_columns  # noqa: E402
from starloom.functions.money import round_money  # noqa: E402
from starloom.operators.cleaning import (  # noqa: E402
    dedupe_by_key,
    distinct_rows,
    drop_nulls,
    first_by_key,
    within_box,
)
from starloom.operators.joins import join_many_to_one, left_join_one_to_many  # noqa: E402
from starloom.plans import ask, bronze, gold, jobs, rollup, silver, star  # noqa: E402
from starloom.sources.multiline_csv import multiline_csv  # noqa: E402
from testbed import dirty, oracle  # noqa: E402
from testbed.lake import (  # noqa: E402
    column_types,
    fact_lakehouse,
    in_files_of,
    incremental_lakehouse,
    loaded_lakehouse,
    new_lakehouse,
    rolled_up_lakehouse,
    write_csv,
    write_source,
)
from testbed.raw import RAW, given  # noqa: E402



def _present(*modules: str) -> bool:
    try:
        return all(find_spec(m) for m in modules)
    except ModuleNotFoundError:  # not even the package
        return False


if _present("corpus_pipeline", "starloom.llm.queries"):  # the training-data operators and their pipeline
    import corpus_pipeline
    from starloom.llm import queries as llm
else:
    corpus_pipeline = llm = None

Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession) -> DataFrame:
    """Load everything from CSV to the star schema, then revenue by month."""
    return q_revenue_by_month(spark, "/root/testdata/sf0.001")


# ---- primitives


def drop_nulls_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_nulls(RAW["payments"](spark, sf_dir))


def drop_nulls_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = given(spark, sf_dir, "lineitem").selectExpr(
        "nullif(l_returnflag, 'A') AS flag", "nullif(l_linestatus, 'O') AS status"
    )
    return drop_nulls(flags, how="all")


def distinct_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_rows(RAW["order_items"](spark, sf_dir))


def dedupe_by_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_by_key(given(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def first_by_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_order = (
        given(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(first_by_key(["l_linenumber", "l_returnflag"]).alias("first"))
    )
    return per_order.select("l_orderkey", F.col("first.l_returnflag").alias("first_flag"))


def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within_box(
        RAW["geolocation"](spark, sf_dir),
        "geolocation_lat",
        "geolocation_lng",
        silver.LAT_RANGE,
        silver.LNG_RANGE,
    )


def join_inner_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = given(spark, sf_dir, "orders").selectExpr("o_orderkey AS order_id", "o_orderstatus")
    lines = given(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS order_id", "l_linenumber", "l_quantity"
    )
    return join_many_to_one(lines, orders, "order_id", "inner")


def join_left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = given(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = given(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    return left_join_one_to_many(orders, lines, "o_orderkey", "l_orderkey").drop("l_orderkey")


def join_on_date_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = RAW["orders"](spark, sf_dir).select("order_id", "order_purchase_timestamp")
    days = dim_date(spark, sf_dir).select("date", "date_key", "is_weekend")
    on_day = F.col("order_purchase_timestamp").cast("date") == F.col("date")
    return orders.join(days, on_day, "inner").select("order_id", "date_key", "is_weekend")


def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RAW["orders"](spark, sf_dir).agg(
        F.min("order_purchase_timestamp").alias("min_date"),
        F.max("order_purchase_timestamp").alias("max_date"),
    )


def scalar_round_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = RAW["order_items"](spark, sf_dir)
    as_int = int_columns(items, ["price", "no_such_column"])
    return items.select(
        "order_id",
        "order_item_id",
        round_money("freight_value").alias("freight"),
        as_int["price"].alias("price_int"),
        int_from_text(F.col("price").cast("decimal(12,2)").cast("string")).alias("price_text_int"),
    )


def date_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = given(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    parts = {k: v for k, v in calendar_columns("day").items() if k != "day"}
    return orders.select("o_orderkey", date_key("day").alias("day_key"), *[v.alias(k) for k, v in parts.items()])


# ---- files and tables


def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, with their line breaks and quotes, through a CSV file."""
    lake = new_lakehouse(spark, "csv_ingest", sf_dir)
    lake.create_layer("bronze")
    documents = given(spark, sf_dir, "documents")
    path = f"{lake.location}/csv/documents.csv"
    write_csv(documents, path)
    bronze.ingest_csv(lake, path, column_types(documents), tuple(documents.columns), multiline=True)
    return lake.read("bronze", "documents")


def csv_ingest_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a single file, which many tasks read; of large inputs one file per `ONE_FILE_BYTES`, as one
    task writes each."""
    documents = given(spark, sf_dir, "documents")
    path = f"{new_lakehouse(spark, 'csv_one', sf_dir).location}/csv/documents.csv"
    write_csv(in_files_of(documents, ONE_FILE_BYTES), path)
    text = multiline_csv(spark, path, documents.columns, range_bytes=1 << 20)
    types = typed_columns(column_types(documents), documents.columns)
    return text.select(*[v.alias(c) for c, v in types.items()])


#: One task reads so much of its input, and writes a file of it.
ONE_FILE_BYTES = 128 << 20


def bronze_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lake = new_lakehouse(spark, "bronze_only", sf_dir)
        lake.create_layer("bronze")
        source_dir = f"{lake.location}/csv"
        types = write_source(spark, sf_dir, name, source_dir)
        bronze.ingest(lake, name, source_dir, types)
        return lake.read("bronze", bronze.SOURCES[name].table)

    return run


def read_layer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_lakehouse(spark, sf_dir).read("silver", "orders")


def write_read_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = new_lakehouse(spark, "roundtrip", sf_dir)
    lake.create_layer("gold")
    lake.write("gold", "lineitem", given(spark, sf_dir, "lineitem"))
    return lake.read("gold", "lineitem")


def load_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loaded_lakehouse(spark, sf_dir).audit(jobs.layer_tables())


def incremental_table(layer: str, table: str) -> Query:
    """A table of a lakehouse that was loaded in two steps; of silver, the table alone."""
    alone = table if layer == "silver" else None
    return lambda spark, sf_dir: incremental_lakehouse(spark, sf_dir, alone).read(layer, table)


# ---- silver from the given tables, gold from the loaded tables


def silver_table(table: str) -> Query:
    build, source = silver.TABLES[table]
    return lambda spark, sf_dir: build(RAW[source](spark, sf_dir))


def gold_table(table: str) -> Query:
    build, inputs = gold.TABLES[table]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lake = loaded_lakehouse(spark, sf_dir)
        return build(*[lake.read(*name) for name in inputs])

    return run


dim_date = gold_table("dim_date")


def fact_sales_attrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = loaded_lakehouse(spark, sf_dir)
    inputs = [name for name in gold.TABLES["fact_sales"][1] if name != ("silver", "hot_keys")]
    return gold.fact_sales_attrition(*[lake.read(*name) for name in inputs])


# ---- queries on the loaded gold tables


def gold_query(build: Callable[..., DataFrame], *dimensions: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lake = loaded_lakehouse(spark, sf_dir)
        return build(lake.read("gold", "fact_sales"), *[lake.read("gold", d) for d in dimensions])

    return run


q_revenue_by_month = gold_query(star.revenue_by_month, "dim_date")

GOLD_SQL = """
SELECT d.year, d.quarter, p.product_category_name_english AS category,
       CAST(sum(CAST(f.price AS DECIMAL(18,2))) AS DOUBLE) AS total_price,
       count(*) AS items
FROM {gold}fact_sales f
JOIN {gold}dim_date d ON f.date_key = d.date_key
JOIN {gold}dim_product p ON f.product_id = p.product_id
GROUP BY d.year, d.quarter, p.product_category_name_english
"""


def gold_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask.gold_sql(loaded_lakehouse(spark, sf_dir), "```sql" + GOLD_SQL.format(gold="iceberg.gold.") + ";```")


CAP_SQL = """
SELECT order_id, order_item_id, product_id, seller_id, price, freight_value
FROM fact_sales
ORDER BY order_id, order_item_id, product_id, seller_id, price, freight_value
"""


def result_row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask.capped(ask.gold_sql(loaded_lakehouse(spark, sf_dir), CAP_SQL))


ROWS_SQL = "SELECT order_id, order_item_id, product_id, seller_id, review_id, price FROM fact_sales"


def answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of an answer, as the table that they are."""
    return ask.answer(loaded_lakehouse(spark, sf_dir), ROWS_SQL)["rows"].frame


def answer_third_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after two others, of 500 rows each, on a load of its own."""
    lake, cursor = fact_lakehouse(spark, sf_dir, "paged"), None
    for _ in range(3):
        got = ask.page(lake, ROWS_SQL, 500, cursor, ["price", "order_id"])
        cursor = got["cursor"]
    return spark.createDataFrame(got["rows"], ask.gold_sql(lake, ROWS_SQL).schema)


LITERAL_SQL = """
SELECT 'iceberg.gold.fact_sales' AS a_name, 'it''s; -- iceberg.silver.x' AS a_text, count(*) AS n
FROM {gold}fact_sales"""


def gold_sql_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = LITERAL_SQL.format(gold="`iceberg`.gold.").replace("''", "\\'")
    return ask.gold_sql(loaded_lakehouse(spark, sf_dir), sql)


def rollup_query(build: Callable[..., DataFrame], *tables: str) -> Query:
    """A star query answered from roll-ups."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lake = rolled_up_lakehouse(spark, sf_dir)
        return build(*[lake.read("gold", t) for t in tables])

    return run


def fact_sales_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact laid out for filters on day, product and seller, as its own load wrote it."""
    by = ["date_key", "product_id", "seller_id"]
    return fact_lakehouse(spark, sf_dir, "clustered", cluster_fact_by=by, fact_files=8).read("gold", "fact_sales")


#: Star query -> how it is answered from roll-ups, with the same result.
ROLLED_UP = {
    "revenue_by_month": (rollup.revenue_by_month, "sales_rollup", "dim_date"),
    "revenue_by_category": (rollup.revenue_by_category, "sales_rollup", "dim_product"),
    "revenue_by_payment_type": (rollup.revenue_by_payment_type, "sales_rollup", "order_rollup"),
    "revenue_by_customer_city": (rollup.revenue_by_customer_city, "customer_rollup", "dim_customer"),
    "freight_by_seller_city": (rollup.freight_by_seller_city, "sales_rollup", "dim_seller"),
    "avg_score_by_category": (rollup.avg_score_by_category, "score_rollup", "dim_product"),
    "weekend_split": (rollup.weekend_split, "sales_rollup", "dim_date"),
    "payment_total_per_month": (rollup.payment_total_per_month, "order_rollup", "dim_date"),
}


# Source -> its name in the oracle; silver table -> its name there; column lists for the audit.
SOURCE_ORACLE = {
    "customers": "r_customers",
    "sellers": "r_sellers",
    "products": "r_products",
    "orders": "r_orders",
    "order_items": "r_items",
    "payments": "r_payments",
    "order_reviews": "r_reviews",
    "product_category": "r_cat",
    "geolocation": "r_geo",
}
SILVER_ORACLE = {
    "customers": "s_customers",
    "sellers": "s_sellers",
    "products": "s_products",
    "order_items": "s_items",
    "payments": "s_payments",
    "order_reviews": "s_reviews",
    "product_category": "s_cat",
    "orders": "s_orders",
    "date": "s_date",
    "geolocation": "s_geo",
}

#: Tables with rows that only both halves of the sources together give.
INCREMENTAL = [("silver", "payments"), ("silver", "order_reviews"), ("silver", "order_items"), ("silver", "sellers"), ("gold", "fact_sales")]

PRODUCT_COLUMNS = (
    "product_id,product_category_name,product_name_length,product_description_length,"
    "product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm"
)
GEO_COLUMNS = (
    "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state"
)
ITEM_COLUMNS = "order_id,order_item_id,product_id,seller_id,price,freight_value"
ORDER_COLUMNS = "order_id,customer_id,order_status,order_purchase_timestamp,order_note"
CATEGORY_COLUMNS = "product_category_name,product_category_name_english"
SELLER_COLUMNS = "seller_id,seller_zip_code_prefix,seller_city"
CUSTOMER_COLUMNS = "customer_id,customer_zip_code_prefix,customer_city"

AUDIT_TABLES = [
    ("bronze", "olist_customers_dataset", "r_customers", CUSTOMER_COLUMNS),
    ("bronze", "olist_sellers_dataset", "r_sellers", SELLER_COLUMNS),
    ("bronze", "olist_products_dataset", "r_products", PRODUCT_COLUMNS),
    ("bronze", "olist_orders_dataset", "r_orders", ORDER_COLUMNS),
    ("bronze", "olist_order_items_dataset", "r_items", ITEM_COLUMNS),
    (
        "bronze",
        "olist_order_payments_dataset",
        "r_payments",
        "order_id,payment_sequential,payment_type,payment_installments,payment_value",
    ),
    (
        "bronze",
        "olist_order_reviews_dataset",
        "r_reviews",
        "review_id,order_id,review_score,review_comment_title,review_comment_message",
    ),
    ("bronze", "product_category_name_translation", "r_cat", CATEGORY_COLUMNS),
    ("bronze", "olist_geolocation_dataset", "r_geo", GEO_COLUMNS),
    ("silver", "customers", "s_customers", CUSTOMER_COLUMNS),
    ("silver", "sellers", "s_sellers", SELLER_COLUMNS),
    ("silver", "products", "s_products", PRODUCT_COLUMNS),
    ("silver", "order_items", "s_items", ITEM_COLUMNS),
    (
        "silver",
        "payments",
        "s_payments",
        "order_id,payment_value,payment_installments,payment_type,payment_sequential,num_payments",
    ),
    (
        "silver",
        "order_reviews",
        "s_reviews",
        "order_id,review_id,review_score,review_comment_message,num_reviews",
    ),
    ("silver", "product_category", "s_cat", CATEGORY_COLUMNS),
    ("silver", "orders", "s_orders", ORDER_COLUMNS),
    ("silver", "date", "s_date", "order_purchase_timestamp"),
    ("silver", "geolocation", "s_geo", GEO_COLUMNS),
    ("gold", "dim_order", "dim_order", "order_id,order_status,payment_type"),
    (
        "gold",
        "dim_customer",
        "dim_customer",
        "customer_id,customer_city,customer_lat,customer_lng",
    ),
    ("gold", "dim_seller", "dim_seller", SELLER_COLUMNS),
    (
        "gold",
        "dim_product",
        "dim_product",
        PRODUCT_COLUMNS.replace(
            "product_category_name,", "product_category_name,product_category_name_english,"
        ),
    ),
    ("gold", "dim_review", "dim_review", "review_id,review_score"),
    (
        "gold",
        "dim_date",
        "dim_date",
        "date,date_key,year,quarter,month,day,day_of_week,week_of_year,month_name,day_name,is_weekend",
    ),
    (
        "gold",
        "fact_sales",
        "fact_sales",
        "order_id,order_item_id,customer_id,product_id,seller_id,review_id,date_key,price,"
        "freight_value,payment_value,payment_installments,payment_sequential",
    ),
]


def queries() -> dict[str, Query]:
    """Query key -> (spark, sf_dir) -> DataFrame."""
    return {
        # primitives
        "drop_nulls_any": drop_nulls_any,
        "drop_nulls_all": drop_nulls_all,
        "distinct_rows": distinct_rows_query,
        "dedupe_by_key": dedupe_by_key_query,
        "first_by_key": first_by_key_query,
        "bbox_filter": bbox_filter,
        "join_inner_using": join_inner_using,
        "join_left_outer": join_left_outer,
        "join_on_date_expr": join_on_date_expr,
        "date_range": date_range,
        "scalar_round_cast": scalar_round_cast,
        "date_key": date_key_query,
        # files and tables
        "csv_ingest": csv_ingest,
        "csv_ingest_one_file": csv_ingest_one_file,
        **{f"bronze_{name}": bronze_query(name) for name in bronze.SOURCES},
        "read_layer_table": read_layer_table,
        "write_read_roundtrip": write_read_roundtrip,
        "load_audit": load_audit,
        # files with values that are not of their columns' types
        "bronze_payments_dirty": dirty.bronze_payments,
        "bronze_payments_rejected": dirty.bronze_payments_rejected,
        "silver_payments_dirty": dirty.silver_payments,
        "silver_order_items_dirty": dirty.silver_order_items,
        "dim_customer_text_zip": dirty.dim_customer,
        # layers
        **{f"silver_{table}": silver_table(table) for table in silver.TABLES},
        **{table: gold_table(table) for table in gold.TABLES},
        "fact_sales_attrition": fact_sales_attrition,
        # queries on the star schema
        "gold_sql": gold_sql,
        "gold_sql_literal": gold_sql_literal,
        "fact_sales_clustered": fact_sales_clustered,
        "answer_rows": answer_rows,
        "answer_third_page": answer_third_page,
        "result_row_cap": result_row_cap,
        "q_revenue_by_month": q_revenue_by_month,
        "q_revenue_by_category": gold_query(star.revenue_by_category, "dim_product"),
        "q_revenue_by_payment_type": gold_query(star.revenue_by_payment_type, "dim_order"),
        "q_revenue_by_customer_city": gold_query(star.revenue_by_customer_city, "dim_customer"),
        "q_freight_by_seller_city": gold_query(star.freight_by_seller_city, "dim_seller"),
        "q_avg_score_by_category": gold_query(
            star.avg_score_by_category, "dim_review", "dim_product"
        ),
        "q_weekend_split": gold_query(star.weekend_split, "dim_date"),
        "q_payment_total_per_month": gold_query(star.payment_total_per_month, "dim_date"),
        **{f"incremental_{table}": incremental_table(layer, table) for layer, table in INCREMENTAL},
        **{f"rollup_{name}": rollup_query(*how) for name, how in ROLLED_UP.items()},
        **({**llm.QUERIES, "pipeline": corpus_pipeline.run} if llm else {}),
    }


def oracle_sql() -> dict[str, str]:
    """Query key -> DuckDB SQL of the expected result."""
    sql, money = oracle.sql, oracle.money
    expected = {
        "drop_nulls_any": sql("SELECT * FROM r_payments WHERE payment_type IS NOT NULL"),
        "drop_nulls_all": """
            SELECT nullif(l_returnflag, 'A') AS flag, nullif(l_linestatus, 'O') AS status
            FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_linestatus = 'O')""",
        "distinct_rows": sql("SELECT DISTINCT * FROM r_items"),
        "dedupe_by_key": """
            SELECT * EXCLUDE (n) FROM (
                SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                    ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
                             l_returnflag, l_linestatus, l_shipdate) AS n
                FROM lineitem) WHERE n = 1""",
        "first_by_key": """
            SELECT l_orderkey,
                   first(l_returnflag ORDER BY l_linenumber, l_returnflag) AS first_flag
            FROM lineitem GROUP BY l_orderkey""",
        "bbox_filter": sql("""
            SELECT * FROM r_geo
            WHERE geolocation_lat >= -33.75116944 AND geolocation_lat <= 5.27438888
              AND geolocation_lng >= -73.98283055 AND geolocation_lng <= -34.79314722"""),
        "join_inner_using": """
            SELECT o_orderkey AS order_id, o_orderstatus, l_linenumber, l_quantity
            FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
        "join_left_outer": """
            SELECT o_orderkey, o_orderstatus, l_quantity, l_returnflag
            FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""",
        "join_on_date_expr": sql("""
            SELECT o.order_id, d.date_key, d.is_weekend
            FROM r_orders o JOIN dim_date d ON CAST(o.order_purchase_timestamp AS DATE) = d.date"""),
        "date_range": sql("""
            SELECT min(order_purchase_timestamp) AS min_date,
                   max(order_purchase_timestamp) AS max_date
            FROM r_orders"""),
        "scalar_round_cast": sql("""
            SELECT order_id, order_item_id,
                   CAST(round(CAST(freight_value AS DECIMAL(16,4)), 2) AS DOUBLE) AS freight,
                   CAST(trunc(price) AS INTEGER) AS price_int,
                   CAST(trunc(price) AS INTEGER) AS price_text_int
            FROM r_items"""),
        "date_key": """
            SELECT o_orderkey,
                   CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS day_key,
                   CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key,
                   CAST(year(o_orderdate) AS INTEGER) AS year,
                   CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
                   CAST(month(o_orderdate) AS INTEGER) AS month,
                   CAST(isodow(o_orderdate) AS INTEGER) AS day_of_week,
                   CAST(weekofyear(o_orderdate) AS INTEGER) AS week_of_year,
                   monthname(o_orderdate) AS month_name, dayname(o_orderdate) AS day_name,
                   isodow(o_orderdate) IN (6, 7) AS is_weekend
            FROM orders""",
        "csv_ingest": "SELECT * FROM documents",
        "csv_ingest_one_file": "SELECT * FROM documents",
        **{f"bronze_{k}": sql(f"SELECT * FROM {v}") for k, v in SOURCE_ORACLE.items()},
        "bronze_payments_dirty": sql("""
            SELECT CAST(order_id AS VARCHAR) AS order_id, payment_sequential, payment_type,
                   payment_installments, payment_value,
                   (SELECT count(*) FROM x_payments WHERE payment_value IS NULL) AS rejected_values
            FROM x_payments"""),
        "bronze_payments_rejected": sql("""
            SELECT 'payment_value' AS column, 'n/a' AS value, 'not of type double' AS reason,
                   order_id || ',' || payment_sequential || ',' || coalesce(payment_type, '') || ','
                       || payment_installments || ',n/a' AS row,
                   true AS file
            FROM x_payments WHERE payment_value IS NULL"""),
        "silver_payments_dirty": sql("""
            SELECT order_id, CAST(sum(CAST(payment_value AS DECIMAL(18,2))) AS DOUBLE) AS payment_value,
                   max(CAST(trunc(CAST(payment_installments AS DOUBLE)) AS INTEGER)) AS payment_installments,
                   first(payment_type ORDER BY payment_sequential, payment_type) AS payment_type,
                   max(payment_sequential) AS payment_sequential, count(*) AS num_payments, mode
            FROM x_payments, modes
            WHERE payment_type IS NOT NULL AND payment_value IS NOT NULL AND payment_installments <> 'n/a'
            GROUP BY order_id, mode"""),
        "silver_order_items_dirty": sql("SELECT s_items.*, mode FROM s_items, modes WHERE product_id % 29 <> 0"),
        "dim_customer_text_zip": sql("""
            SELECT customer_id, customer_city, customer_lat, customer_lng, mode
            FROM (SELECT c.customer_id, c.customer_city, g.geolocation_lat AS customer_lat,
                         g.geolocation_lng AS customer_lng,
                         row_number() OVER (PARTITION BY c.customer_id
                            ORDER BY c.customer_city, g.geolocation_lat NULLS FIRST,
                                     g.geolocation_lng NULLS FIRST) AS n
                  FROM x_customers c LEFT JOIN s_geo g ON c.zip = g.geolocation_zip_code_prefix), modes
            WHERE n = 1"""),
        "read_layer_table": sql("SELECT * FROM s_orders"),
        "write_read_roundtrip": "SELECT * FROM lineitem",
        "load_audit": oracle.audit(AUDIT_TABLES),
        **{f"silver_{k}": sql(f"SELECT * FROM {v}") for k, v in SILVER_ORACLE.items()},
        **{table: sql(f"SELECT * FROM {table}") for table in gold.TABLES},
        "fact_sales_attrition": sql("""
            SELECT CAST(position AS INTEGER) AS position, step, rows_before, rows_after,
                   rows_before - rows_after AS lost
            FROM (
                SELECT unnest([1, 2, 3, 4, 5, 6, 7]) AS position,
                       unnest(['order', 'payment', 'review', 'customer', 'day', 'product', 'seller']) AS step,
                       unnest([n0, n1, n2, n3, n4, n5, n6]) AS rows_before,
                       unnest([n1, n2, n3, n4, n5, n6, n7]) AS rows_after
                FROM (
                    SELECT count(*) AS n0, count(*) FILTER (o) AS n1, count(*) FILTER (o AND p) AS n2,
                           count(*) FILTER (o AND p AND r) AS n3, count(*) FILTER (o AND p AND r AND c) AS n4,
                           count(*) FILTER (o AND p AND r AND c AND d) AS n5,
                           count(*) FILTER (o AND p AND r AND c AND d AND pr) AS n6,
                           count(*) FILTER (o AND p AND r AND c AND d AND pr AND s) AS n7
                    FROM (
                        SELECT so.order_id IS NOT NULL AS o,
                               i.order_id IN (SELECT order_id FROM s_payments) AS p,
                               i.order_id IN (SELECT order_id FROM s_reviews) AS r,
                               coalesce(so.customer_id IN (SELECT customer_id FROM dim_customer), false) AS c,
                               coalesce(CAST(so.order_purchase_timestamp AS DATE)
                                   IN (SELECT date FROM dim_date), false) AS d,
                               i.product_id IN (SELECT product_id FROM dim_product) AS pr,
                               i.seller_id IN (SELECT seller_id FROM dim_seller) AS s
                        FROM s_items i LEFT JOIN s_orders so ON i.order_id = so.order_id)))"""),
        "gold_sql": sql(GOLD_SQL.format(gold="")),
        "gold_sql_literal": sql(LITERAL_SQL.format(gold="")),
        "fact_sales_clustered": sql("SELECT * FROM fact_sales"),
        "answer_rows": sql(ROWS_SQL),
        "answer_third_page": sql(f"""
            SELECT * FROM ({ROWS_SQL})
            ORDER BY price, order_id, order_item_id, product_id, seller_id, review_id
            LIMIT 500 OFFSET 1000"""),
        "result_row_cap": sql(CAP_SQL + " LIMIT 5000"),
        "q_revenue_by_month": sql(f"""
            SELECT d.year, d.month, d.month_name, {money("f.price")} AS revenue,
                   count(*) AS items
            FROM fact_sales f JOIN dim_date d ON f.date_key = d.date_key
            GROUP BY d.year, d.month, d.month_name"""),
        "q_revenue_by_category": sql(f"""
            SELECT p.product_category_name_english AS category, {money("f.price")} AS revenue,
                   count(*) AS items
            FROM fact_sales f JOIN dim_product p ON f.product_id = p.product_id
            GROUP BY p.product_category_name_english"""),
        "q_revenue_by_payment_type": sql(f"""
            SELECT o.payment_type, {money("f.price")} AS revenue,
                   count(DISTINCT f.order_id) AS orders
            FROM fact_sales f JOIN dim_order o ON f.order_id = o.order_id
            GROUP BY o.payment_type"""),
        "q_revenue_by_customer_city": sql(f"""
            SELECT c.customer_city, {money("f.price")} AS revenue,
                   count(DISTINCT f.customer_id) AS customers
            FROM fact_sales f JOIN dim_customer c ON f.customer_id = c.customer_id
            GROUP BY c.customer_city"""),
        "q_freight_by_seller_city": sql(f"""
            SELECT s.seller_city, {money("f.freight_value")} AS freight,
                   count(DISTINCT f.seller_id) AS sellers
            FROM fact_sales f JOIN dim_seller s ON f.seller_id = s.seller_id
            GROUP BY s.seller_city"""),
        "q_avg_score_by_category": sql("""
            SELECT p.product_category_name_english AS category,
                   CAST(sum(r.review_score) AS DOUBLE) / count(*) AS avg_score,
                   count(*) AS items
            FROM fact_sales f
            JOIN (SELECT review_id, min(review_score) AS review_score
                  FROM dim_review GROUP BY review_id) r ON f.review_id = r.review_id
            JOIN dim_product p ON f.product_id = p.product_id
            GROUP BY p.product_category_name_english"""),
        "q_weekend_split": sql(f"""
            SELECT d.is_weekend, {money("f.price")} AS revenue, count(*) AS items
            FROM fact_sales f JOIN dim_date d ON f.date_key = d.date_key
            GROUP BY d.is_weekend"""),
        "q_payment_total_per_month": sql(f"""
            SELECT d.year, d.month, {money("o.payment_value")} AS payments, count(*) AS orders
            FROM (SELECT DISTINCT order_id, date_key, payment_value FROM fact_sales) o
            JOIN dim_date d ON o.date_key = d.date_key
            GROUP BY d.year, d.month"""),
        **{f"incremental_{t}": sql(f"SELECT * FROM {SILVER_ORACLE[t] if layer == 'silver' else t}") for layer, t in INCREMENTAL},
        **(llm.ORACLE_SQL if llm else {}),
    }
    return expected | {f"rollup_{name}": expected[f"q_{name}"] for name in ROLLED_UP}

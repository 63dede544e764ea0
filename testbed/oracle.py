"""Expected results as DuckDB SQL over the given tables, written independently of the library.

Each table of the pipeline is a common table expression; `sql` puts those a query needs before it.
"""

from __future__ import annotations

import re

TABLES = {
    # ---- source tables
    "r_customers": """
        SELECT c_custkey AS customer_id, c_nationkey AS customer_zip_code_prefix,
               nullif(c_mktsegment, 'MACHINERY') AS customer_city
        FROM customer
        UNION ALL
        SELECT c_custkey, c_nationkey, nullif(c_mktsegment, 'MACHINERY')
        FROM customer WHERE c_custkey % 10 = 0""",
    "r_sellers": """
        SELECT s_suppkey AS seller_id, s_nationkey AS seller_zip_code_prefix,
               CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS seller_city
        FROM supplier
        UNION ALL
        SELECT s_suppkey, s_nationkey + 1, concat(s_name, '#dup')
        FROM supplier WHERE s_suppkey % 5 = 0""",
    "r_products": """
        SELECT p_partkey AS product_id,
               CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS product_category_name,
               CAST(length(p_name) AS INTEGER) AS product_name_length,
               p_retailprice AS product_description_length,
               p_size AS product_photos_qty,
               p_retailprice AS product_weight_g,
               CAST(p_size AS DOUBLE) + CAST(0.7 AS DOUBLE) AS product_length_cm,
               CAST(p_size AS DOUBLE) + CAST(1.7 AS DOUBLE) AS product_height_cm,
               CAST(p_size AS DOUBLE) + CAST(2.7 AS DOUBLE) AS product_width_cm
        FROM part""",
    "r_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
               o_orderdate AS order_purchase_timestamp,
               nullif(o_orderpriority, '5-LOW') AS order_note
        FROM orders
        UNION ALL
        SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate + INTERVAL 1 DAY, o_orderpriority
        FROM orders WHERE o_orderkey % 100 = 0 AND o_orderpriority <> '5-LOW'""",
    "r_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
               l_suppkey AS seller_id, l_extendedprice AS price,
               CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DOUBLE)
                   AS freight_value
        FROM lineitem
        UNION ALL
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
               CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DOUBLE)
        FROM lineitem WHERE l_orderkey % 50 = 0""",
    "r_payments": """
        SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential,
               CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE l_returnflag END AS payment_type,
               CAST(l_quantity AS INTEGER) AS payment_installments,
               l_extendedprice AS payment_value
        FROM lineitem""",
    "r_reviews": """
        SELECT event_id AS review_id, event_id // 2 AS order_id,
               CASE WHEN event_id % 41 = 0 THEN 'bad'
                    ELSE CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 + 1 AS VARCHAR)
               END AS review_score,
               CAST(NULL AS VARCHAR) AS review_comment_title,
               nullif(event_type, 'error') AS review_comment_message
        FROM events""",
    "r_cat": """
        SELECT DISTINCT p_type AS product_category_name,
               concat(lower(p_type), '_en') AS product_category_name_english
        FROM part WHERE p_type <> 'ECONOMY'""",
    "r_geo": """
        SELECT s_nationkey AS geolocation_zip_code_prefix,
               s_acctbal / CAST(250 AS DOUBLE) - CAST(35 AS DOUBLE) AS geolocation_lat,
               -s_acctbal / CAST(200 AS DOUBLE) - CAST(30 AS DOUBLE) AS geolocation_lng,
               s_name AS geolocation_city, 'XX' AS geolocation_state
        FROM (SELECT * FROM supplier
              UNION ALL SELECT * FROM supplier WHERE s_suppkey % 4 = 0)""",
    # ---- sources with values that are not of their type
    "x_payments": """
        SELECT order_id, payment_sequential, payment_type,
               CASE WHEN order_id % 13 = 0 THEN concat(payment_installments, '.9')
                    WHEN order_id % 17 = 0 THEN concat(payment_installments, '.0')
                    WHEN order_id % 19 = 0 THEN 'n/a'
                    ELSE CAST(payment_installments AS VARCHAR) END AS payment_installments,
               CASE WHEN payment_sequential = 7 THEN NULL ELSE payment_value END AS payment_value
        FROM r_payments""",
    "x_customers": """
        SELECT DISTINCT customer_id, customer_city,
               CASE WHEN customer_id % 11 <> 0 THEN customer_zip_code_prefix END AS zip
        FROM r_customers WHERE customer_city IS NOT NULL""",
    "modes": "SELECT unnest(['declared', 'inferred']) AS mode",
    # ---- silver
    "s_customers": """
        SELECT DISTINCT * FROM r_customers
        WHERE customer_id IS NOT NULL AND customer_zip_code_prefix IS NOT NULL
          AND customer_city IS NOT NULL""",
    "s_sellers": """
        SELECT seller_id, seller_zip_code_prefix, seller_city
        FROM (SELECT *, row_number() OVER (PARTITION BY seller_id
                        ORDER BY seller_zip_code_prefix, seller_city) AS n
              FROM r_sellers WHERE seller_city IS NOT NULL)
        WHERE n = 1""",
    "s_products": """
        SELECT product_id, product_category_name, product_name_length,
               CAST(trunc(product_description_length) AS INTEGER) AS product_description_length,
               product_photos_qty, product_weight_g,
               CAST(trunc(product_length_cm) AS INTEGER) AS product_length_cm,
               CAST(trunc(product_height_cm) AS INTEGER) AS product_height_cm,
               CAST(trunc(product_width_cm) AS INTEGER) AS product_width_cm
        FROM (SELECT DISTINCT * FROM r_products WHERE product_category_name IS NOT NULL)""",
    "s_items": """
        SELECT DISTINCT order_id, order_item_id, product_id, seller_id,
               CAST(round(CAST(price AS DECIMAL(16,4)), 2) AS DOUBLE) AS price,
               CAST(round(CAST(freight_value AS DECIMAL(16,4)), 2) AS DOUBLE) AS freight_value
        FROM r_items""",
    "s_payments": """
        SELECT order_id,
               CAST(sum(CAST(payment_value AS DECIMAL(18,2))) AS DOUBLE) AS payment_value,
               max(payment_installments) AS payment_installments,
               first(payment_type ORDER BY payment_sequential, payment_type) AS payment_type,
               max(payment_sequential) AS payment_sequential,
               count(*) AS num_payments
        FROM r_payments WHERE payment_type IS NOT NULL
        GROUP BY order_id""",
    "s_reviews": """
        SELECT order_id, review_id, review_score, review_comment_message, num_reviews
        FROM (SELECT order_id, review_id, TRY_CAST(review_score AS INTEGER) AS review_score,
                     review_comment_message,
                     row_number() OVER (PARTITION BY order_id ORDER BY review_id) AS n,
                     count(*) OVER (PARTITION BY order_id) AS num_reviews
              FROM r_reviews
              WHERE TRY_CAST(review_score AS INTEGER) IS NOT NULL
                AND review_comment_message IS NOT NULL)
        WHERE n = 1""",
    "s_cat": "SELECT DISTINCT * FROM r_cat",
    "s_orders": """
        SELECT order_id, customer_id, order_status, order_purchase_timestamp, order_note
        FROM (SELECT *, row_number() OVER (PARTITION BY order_id
                        ORDER BY customer_id, order_status, order_purchase_timestamp, order_note) AS n
              FROM r_orders WHERE order_note IS NOT NULL)
        WHERE n = 1""",
    "s_date": "SELECT DISTINCT order_purchase_timestamp FROM r_orders",
    "s_geo": """
        SELECT DISTINCT * FROM r_geo
        WHERE geolocation_lat >= -33.75116944 AND geolocation_lat <= 5.27438888
          AND geolocation_lng >= -73.98283055 AND geolocation_lng <= -34.79314722""",
    # ---- gold
    "dim_order": """
        SELECT o.order_id, o.order_status, p.payment_type
        FROM s_orders o JOIN s_payments p ON o.order_id = p.order_id""",
    "dim_customer": """
        SELECT customer_id, customer_city, customer_lat, customer_lng
        FROM (SELECT c.customer_id, c.customer_city, g.geolocation_lat AS customer_lat,
                     g.geolocation_lng AS customer_lng,
                     row_number() OVER (PARTITION BY c.customer_id
                        ORDER BY c.customer_city, g.geolocation_lat NULLS FIRST,
                                 g.geolocation_lng NULLS FIRST) AS n
              FROM s_customers c
              LEFT JOIN s_geo g ON c.customer_zip_code_prefix = g.geolocation_zip_code_prefix)
        WHERE n = 1""",
    "dim_seller": "SELECT * FROM s_sellers",
    "dim_product": """
        SELECT p.product_id, c.product_category_name, c.product_category_name_english,
               p.product_name_length, p.product_description_length, p.product_photos_qty,
               p.product_weight_g, p.product_length_cm, p.product_height_cm, p.product_width_cm
        FROM s_products p JOIN s_cat c ON p.product_category_name = c.product_category_name""",
    "dim_review": "SELECT review_id, review_score FROM s_reviews",
    "dim_date": """
        SELECT date,
               CAST(year(date) * 10000 + month(date) * 100 + day(date) AS INTEGER) AS date_key,
               CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter,
               CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day,
               CAST(isodow(date) AS INTEGER) AS day_of_week,
               CAST(weekofyear(date) AS INTEGER) AS week_of_year,
               monthname(date) AS month_name, dayname(date) AS day_name,
               isodow(date) IN (6, 7) AS is_weekend
        FROM (SELECT CAST(unnest(generate_series(
                         CAST(CAST(min(order_purchase_timestamp) AS DATE) AS TIMESTAMP),
                         CAST(CAST(max(order_purchase_timestamp) AS DATE) AS TIMESTAMP),
                         INTERVAL 1 DAY)) AS DATE) AS date
              FROM s_date)""",
    "fact_sales": """
        SELECT o.order_id, i.order_item_id, o.customer_id, i.product_id, i.seller_id, r.review_id,
               d.date_key, i.price, i.freight_value, p.payment_value, p.payment_installments,
               p.payment_sequential
        FROM s_orders o
        JOIN s_items i ON o.order_id = i.order_id
        JOIN dim_order dor ON o.order_id = dor.order_id
        JOIN dim_product dp ON i.product_id = dp.product_id
        JOIN dim_customer dc ON o.customer_id = dc.customer_id
        JOIN dim_seller ds ON i.seller_id = ds.seller_id
        JOIN s_payments p ON o.order_id = p.order_id
        JOIN s_reviews r ON o.order_id = r.order_id
        JOIN dim_date d ON CAST(o.order_purchase_timestamp AS DATE) = d.date""",
}


def sql(query: str) -> str:
    """`query` with the tables it names, directly or through others, defined before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in TABLES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(TABLES[name])
                if name not in needed:
                    needed.append(name)

    visit(query)
    if not needed:
        return query
    definitions = ",\n".join(f"{name} AS ({TABLES[name]})" for name in needed)
    return f"WITH {definitions}\n{query}"


def money(expression: str) -> str:
    """Exact sum of amounts of two decimal places."""
    return f"CAST(sum(CAST({expression} AS DECIMAL(18,2))) AS DOUBLE)"


def audit(tables: list[tuple[str, str, str, str]]) -> str:
    """Load audit of (layer, table, its name here, its columns)."""
    return sql(
        "\nUNION ALL ".join(
            f"SELECT '{layer}' AS layer, '{table}' AS table_name, count(*) AS row_count,"
            f" CAST({columns.count(',') + 1} AS INTEGER) AS column_count, '{columns}' AS columns"
            f" FROM {name}"
            for layer, table, name, columns in tables
        )
    )

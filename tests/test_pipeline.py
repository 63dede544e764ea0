"""The whole run on nine small hand-made files with text ids."""

import pytest

from starloom.plans import ask, jobs
from testbed.lake import new_lakehouse

FILES = {
    "olist_customers_dataset": """customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state
c1,u1,01310,sao paulo,SP
c1,u1,01310,sao paulo,SP
c2,u2,20000,rio,RJ
c3,u3,20000,,RJ
""",
    "olist_sellers_dataset": """seller_id,seller_zip_code_prefix,seller_city,seller_state
s1,01310,campinas,SP
s1,01311,santos,SP
s2,20000,,RJ
""",
    "olist_products_dataset": """product_id,product_category_name,product_name_length,product_description_length,product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm
p1,brinquedos,40,287,1,225,16,10,14.7
p2,sem_traducao,40,287,1,225,16,10,14
p3,,40,287,1,225,16,10,14
""",
    "olist_orders_dataset": """order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at
o1,c1,delivered,2017-12-31 23:59:59,2018-01-01 00:10:00
o2,c2,delivered,2018-01-06 10:00:00,2018-01-06 10:10:00
o3,c2,canceled,2018-01-07 10:00:00,
o4,c3,delivered,2018-01-02 10:00:00,2018-01-02 10:10:00
o5,c2,delivered,2018-01-02 10:00:00,2018-01-02 10:10:00
o6,c2,delivered,2018-01-03 10:00:00,2018-01-03 10:10:00
""",
    "olist_order_items_dataset": """order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value
o1,1,p1,s1,2018-01-05 00:00:00,10.10,1.005
o1,2,p1,s1,2018-01-05 00:00:00,10.10,2.25
o1,2,p1,s1,2018-01-05 00:00:00,10.10,2.25
o1,3,p2,s1,2018-01-05 00:00:00,99.00,2.25
o1,4,p1,s2,2018-01-05 00:00:00,99.00,2.25
o2,1,p1,s1,2018-01-09 00:00:00,0.20,0.10
o3,1,p1,s1,2018-01-09 00:00:00,77.00,0.10
o4,1,p1,s1,2018-01-09 00:00:00,77.00,0.10
o5,1,p1,s1,2018-01-09 00:00:00,77.00,0.10
o6,1,p1,s1,2018-01-09 00:00:00,77.00,0.10
""",
    "olist_order_payments_dataset": """order_id,payment_sequential,payment_type,payment_installments,payment_value
o1,2,credit_card,3,20.10
o1,1,voucher,1,3.35
o2,1,boleto,1,0.30
o3,1,boleto,1,77.10
o4,1,boleto,1,77.10
o6,1,boleto,1,77.10
""",
    "olist_order_reviews_dataset": '''review_id,order_id,review_score,review_comment_title,review_comment_message
r2,o1,1,,"changed my mind"
r1,o1,5,great,"good, really
""good"""
r3,o2,4,,ok
r4,o3,4,,ok
r5,o4,4,,ok
r5,o5,4,,ok
r6,o6,4,no message,
''',
    "product_category_name_translation": """product_category_name,product_category_name_english
brinquedos,toys
""",
    "olist_geolocation_dataset": """geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state
01310,-23.5,-46.6,sao paulo,SP
01310,-23.6,-46.5,sao paulo,SP
01310,-23.6,-46.5,sao paulo,SP
01310,45.0,-46.5,far away,SP
""",
}


@pytest.fixture(scope="module", params=["typed", "inferred"])
def lake(spark, tmp_path_factory, request):
    folder = tmp_path_factory.mktemp("sources")
    for name, text in FILES.items():
        (folder / f"{name}.csv").write_text(text)
    lake = new_lakehouse(spark, f"small_{request.param}")
    jobs.run_all(lake, str(folder), infer_schema=request.param == "inferred")
    return lake


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_fact(lake):
    """o3 lacks a field, o4's customer a city, o5 a payment, o6 a message; p2 lacks a translation, s2 a city."""
    assert rows(lake.read("gold", "fact_sales")) == [
        ("o1", 1, "c1", "p1", "s1", "r1", 20171231, 10.1, 1.01, 23.45, 3, 2),
        ("o1", 2, "c1", "p1", "s1", "r1", 20171231, 10.1, 2.25, 23.45, 3, 2),
        ("o2", 1, "c2", "p1", "s1", "r3", 20180106, 0.2, 0.1, 0.3, 1, 1),
    ]


def test_silver(lake):
    review = lake.read("silver", "order_reviews").filter("order_id = 'o1'").first()
    assert tuple(review) == ("o1", "r1", 5, 'good, really\n"good"', 2)
    assert lake.read("silver", "payments").filter("order_id = 'o1'").first().payment_type == "voucher"
    assert lake.read("silver", "orders").count() == 5
    assert lake.read("silver", "date").count() == 5
    assert lake.read("silver", "products").filter("product_id = 'p1'").first().product_width_cm == 14
    assert lake.read("silver", "geolocation").count() == 2


def test_dimensions(lake):
    customers = lake.read("gold", "dim_customer").select("customer_id", "customer_city", "customer_lat", "customer_lng")
    assert rows(customers.filter("customer_id = 'c1'")) == [("c1", "sao paulo", -23.6, -46.5)]
    assert rows(customers.filter("customer_lat IS NULL").select("customer_id")) == [("c2",)]
    assert rows(lake.read("gold", "dim_seller").select("seller_id", "seller_city")) == [("s1", "campinas")]
    assert lake.read("gold", "dim_date").count() == 8
    assert lake.read("gold", "dim_review").count() == 5


def test_question(lake):
    got = ask.answer(
        lake,
        """SELECT d.year, SUM(f.price) AS total_price
        FROM iceberg.gold.fact_sales f JOIN iceberg.gold.dim_date d ON f.date_key = d.date_key
        GROUP BY d.year ORDER BY d.year;""",
    )
    assert got["columns"] == ["year", "total_price"]
    assert got["rows"] == [{"year": 2017, "total_price": 20.2}, {"year": 2018, "total_price": 0.2}]

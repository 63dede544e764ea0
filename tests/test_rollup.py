"""Roll-ups of the fact: grain, plans, and that they follow incremental loads."""

import __spark_entry__ as entry
from starloom.plans import incremental, jobs, rollup, star
from tests.conftest import TESTDATA
from tests.test_incremental import MORE, header, lakehouse, put
from tests.test_pipeline import FILES
from testbed.lake import rolled_up_lakehouse

SF_DIR = f"{TESTDATA}/sf0.01"


def test_grain(spark):
    lake = rolled_up_lakehouse(spark, SF_DIR)
    sales, fact = lake.read("gold", "sales_rollup"), lake.read("gold", "fact_sales")
    keys = ["date_key", "product_id", "seller_id", "payment_type"]
    assert sales.select(keys).distinct().count() == sales.count()
    assert sales.agg({"items": "sum"}).first()[0] == fact.count()
    orders = lake.read("gold", "order_rollup")
    assert orders.agg({"orders": "sum"}).first()[0] == fact.select("order_id").distinct().count()
    assert lake.read("gold", "customer_rollup").count() == fact.select("customer_id").distinct().count()


def test_no_query_reads_the_fact(spark):
    lake = rolled_up_lakehouse(spark, SF_DIR)
    (part,) = lake.parts("gold", "fact_sales")
    for name in entry.ROLLED_UP:
        plan = entry.queries()[f"rollup_{name}"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert part not in plan and "_rollup__v" in plan


def test_they_follow_new_files(spark, tmp_path):
    for source, text in FILES.items():
        put(tmp_path, source, "a.csv", text)
    lake = lakehouse(spark)
    incremental.run_incremental(lake, str(tmp_path))
    jobs.run_rollups(lake)
    for source, text in MORE.items():
        put(tmp_path, source, "b.csv", header(source) + text)
    incremental.run_incremental(lake, str(tmp_path))
    read = lambda t: lake.read("gold", t)
    fact = read("fact_sales")
    assert sorted(rollup.revenue_by_month(read("sales_rollup"), read("dim_date")).collect()) == sorted(
        star.revenue_by_month(fact, read("dim_date")).collect()
    )
    assert sorted(rollup.payment_total_per_month(read("order_rollup"), read("dim_date")).collect()) == sorted(
        star.payment_total_per_month(fact, read("dim_date")).collect()
    )
    assert incremental.run_incremental(lake, str(tmp_path)).get("gold") is None

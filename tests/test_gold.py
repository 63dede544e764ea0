"""Gold tables: grain, fan-out, filters, balance under hot keys."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from starloom.operators.joins import HotKeys, count_hot_keys, join_many_to_one, left_join_one_to_many
from starloom.plans import gold, silver, star
from testbed.raw import RAW

SF = "/root/testdata/sf0.001"


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan_after_run(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan


@pytest.fixture
def conf(spark):
    """Set session settings for one test."""
    before = {}

    def set_all(settings):
        for key, value in settings.items():
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield set_all
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


SPLIT_SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
}


@pytest.fixture(scope="module")
def layers(spark):
    tables = {t: build(RAW[source](spark, SF)).cache() for t, (build, source) in silver.TABLES.items()}
    frames = {("silver", t): df for t, df in tables.items()}
    frames["silver", "hot_keys"] = silver.hot_keys(tables["orders"], tables["order_items"])
    for table, (build, inputs) in gold.TABLES.items():
        frames["gold", table] = build(*[frames[i] for i in inputs]).cache()
    return frames


@pytest.mark.parametrize(
    ("layer", "table", "key"),
    [
        ("silver", "sellers", "seller_id"),
        ("silver", "orders", "order_id"),
        ("silver", "payments", "order_id"),
        ("silver", "order_reviews", "order_id"),
        ("gold", "dim_order", "order_id"),
        ("gold", "dim_customer", "customer_id"),
        ("gold", "dim_seller", "seller_id"),
        ("gold", "dim_date", "date_key"),
    ],
)
def test_one_row_per_key(layers, layer, table, key):
    df = layers[layer, table]
    assert df.count() == df.select(key).distinct().count() > 0


def test_expected_row_counts(layers):
    counts = {t: layers["gold", t].count() for t in gold.TABLES}
    assert counts == {
        "dim_order": 1182,
        "dim_customer": 120,
        "dim_seller": 9,
        "dim_product": 150,
        "dim_review": 474,
        "dim_date": 2405,
        "fact_sales": 836,
    }


def test_payment_counts_add_up(spark, layers):
    complete = RAW["payments"](spark, SF).na.drop().count()
    assert layers["silver", "payments"].agg(F.sum("num_payments")).first()[0] == complete


def test_dates_have_no_gaps_and_cover_the_fact(layers):
    days = layers["gold", "dim_date"]
    first, last, n = days.agg(F.min("date"), F.max("date"), F.count("*")).first()
    assert (last - first).days + 1 == n
    assert layers["gold", "fact_sales"].join(days, "date_key", "left_anti").count() == 0


def test_fact_equals_the_plain_chain_of_inner_joins(layers):
    """Semi-joins and the left-out order dimension change nothing."""
    silver_, gold_ = (lambda t: layers["silver", t]), (lambda t: layers["gold", t])
    chain = (
        silver_("orders")
        .drop("order_status")
        .join(silver_("order_items"), "order_id")
        .join(gold_("dim_order").select("order_id"), "order_id")
        .join(gold_("dim_product").select("product_id"), "product_id")
        .join(gold_("dim_customer").select("customer_id"), "customer_id")
        .join(gold_("dim_seller").select("seller_id"), "seller_id")
        .join(silver_("payments"), "order_id")
        .join(silver_("order_reviews"), "order_id")
        .withColumn("date", F.col("order_purchase_timestamp").cast("date"))
        .join(gold_("dim_date"), "date")
        .select(gold_("fact_sales").columns)
    )
    assert values(chain) == values(gold_("fact_sales"))


def test_empty_dates_give_no_calendar(spark):
    empty = spark.createDataFrame([], "order_purchase_timestamp timestamp_ntz")
    assert gold.dim_date(empty).count() == 0


def test_calendar_includes_both_ends(spark):
    df = spark.sql(
        "SELECT explode(array(timestamp_ntz'2020-02-28 23:59:59', timestamp_ntz'2020-03-01 00:00:00'))"
        " AS order_purchase_timestamp"
    )
    days = [r.date for r in gold.dim_date(df).orderBy("date").collect()]
    assert days == [datetime.date(2020, 2, 28), datetime.date(2020, 2, 29), datetime.date(2020, 3, 1)]


def test_customer_gets_one_point_of_its_zip(spark):
    customers = spark.createDataFrame(
        [("a", 1, "x"), ("b", 2, "y"), ("a", 1, "w")],
        "customer_id string, customer_zip_code_prefix int, customer_city string",
    )
    points = spark.createDataFrame(
        [(1, -2.0, -50.0, "c", "s"), (1, -3.0, -40.0, "c", "s"), (1, -3.0, -45.0, "c", "s"), (3, 0.0, -50.0, "c", "s")],
        "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double,"
        " geolocation_city string, geolocation_state string",
    )
    out = gold.dim_customer(customers, points)
    assert out.columns == ["customer_id", "customer_city", "customer_lat", "customer_lng"]
    assert values(out) == [("a", "w", -3.0, -45.0), ("b", "y", None, None)]


def test_repeated_review_id(spark):
    """The dimension keeps both rows; the average counts each item once."""
    reviews = spark.createDataFrame([("r", "o1", 5), ("r", "o2", 3)], "review_id string, order_id string, review_score int")
    review_dim = gold.dim_review(reviews)
    assert review_dim.count() == 2
    fact = spark.createDataFrame([("r", "p")] * 3, "review_id string, product_id string")
    products = spark.createDataFrame([("p", "toys")], "product_id string, product_category_name_english string")
    assert values(star.avg_score_by_category(fact, review_dim, products)) == [("toys", 3.0, 3)]


def test_payment_total_counts_an_order_once(spark):
    fact = spark.createDataFrame(
        [("o", 20200101, 10.1)] * 4 + [("p", 20200102, 0.2)], "order_id string, date_key int, payment_value double"
    )
    days = spark.createDataFrame([(20200101, 2020, 1), (20200102, 2020, 1)], "date_key int, year int, month int")
    assert values(star.payment_total_per_month(fact, days)) == [(2020, 1, 10.3, 2)]


# ---- joins and hot keys


@pytest.mark.parametrize("hot_rows", [1, 100])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_many_to_one_equals_a_plain_join(spark, conf, how, hot_rows):
    conf({"spark.sql.autoBroadcastJoinThreshold": "-1"})
    many = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k bigint, v string")
    one = spark.createDataFrame([(1, "x"), (1, "xx"), (3, "y"), (None, "z")], "k bigint, w string")
    for other in (one, one.withColumn("k", F.col("k").cast("int")), one.withColumn("k", F.col("k").cast("double"))):
        hot = hot_of(many, "k", hot_rows)
        got, want = join_many_to_one(many, other, "k", how, hot), many.join(other, "k", how)
        assert got.columns == want.columns
        assert values(got) == values(want)


def test_small_side_is_broadcast_and_nothing_counted(spark):
    many, one = hot(spark, 1000, 7, 100), spark.range(100).select(F.col("id").alias("k"))
    plan = join_many_to_one(many, one, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "Aggregate" not in plan


def test_hot_key_is_spread_without_adaptive_execution(spark, conf):
    conf(
        {
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.enabled": "false",
            "spark.sql.shuffle.partitions": "16",
        }
    )
    many = hot(spark, 300_000, 7, 20_000)
    one = spark.range(20_000).select(F.col("id").alias("k"), F.lit("w").alias("w"))
    limits = hot_of(many, "k", 5_000)
    assert len(limits.parts) == 1
    joined = join_many_to_one(many, one, "k", hot=limits)
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 300_000
    assert max(sizes) < 2 * 300_000 / 16
    plain = many.join(one, "k").groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in plain.collect()) > 100_000


NO_HELP = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


def test_hot_key_of_equal_rows_is_spread(spark, conf):
    """Rows of one key that are all alike."""
    conf(NO_HELP)
    many = hot(spark, 300_000, 7, 20_000).select("k", F.lit("same").alias("v"))
    one = spark.range(20_000).select(F.col("id").alias("k"), F.lit("w").alias("w"))
    joined = join_many_to_one(many, one, "k", hot=hot_of(many, "k", 5_000))
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 300_000
    assert max(sizes) < 2 * 300_000 / 16
    assert joined.count() == joined.filter("v = 'same' AND w = 'w'").count() == 300_000


def test_rows_without_a_key_go_past_a_left_join(spark, conf):
    conf(NO_HELP)
    many = hot(spark, 300_000, 7, 20_000).withColumn("k", F.expr("nullif(k, 7)"))
    one = spark.range(20_000).select(F.col("id").alias("k"), F.lit("w").alias("w"))
    joined = join_many_to_one(many.repartition(16), one, "k", "left")
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 300_000
    assert max(sizes) < 2 * 300_000 / 16
    assert joined.filter("w IS NULL").count() == many.filter("k IS NULL").count()


def test_hot_keys_are_counted_in_one_pass(spark):
    items = spark.range(100).selectExpr("id % 2 AS a", "id % 50 AS b", "CASE WHEN id < 60 THEN 1 END AS c")
    counts = count_hot_keys(items, ["a", "b", "c"], 20)
    assert counts._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    assert values(counts) == [("a", "0", 50), ("a", "1", 50), ("c", "1", 60)]
    assert HotKeys.of(counts, 20)["c"] == HotKeys((("1", 3),), 20)
    assert HotKeys.of(counts.filter("false")) == {}


def test_keys_that_cannot_be_hot_are_not_counted_one_by_one(spark):
    """Only the values of buckets that are large enough are: here those of `a`, none of the 5,000 of `b`."""
    items = spark.range(10_000).selectExpr("id % 2 AS a", "id % 5000 AS b")
    counts = count_hot_keys(items, ["a", "b"], 1_000)
    assert values(counts) == [("a", "0", 5_000), ("a", "1", 5_000)]
    assert "AS b" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in count_hot_keys(items, ["a", "b"], 5_000)._jdf.queryExecution().optimizedPlan().toString()


def test_items_meet_the_orders_first(layers):
    build, inputs = gold.TABLES["fact_sales"]
    fact = build(*[layers[name] for name in inputs])
    plan = fact._jdf.queryExecution().analyzed().toString()
    order = re.findall(r"Join \w+, \(+(\w+)#", plan)
    assert order[:3] == ["seller_id", "product_id", "order_id"]  # the last is done first
    assert "Aggregate" not in plan[: plan.index("order_id#")]


def test_one_to_many_equals_a_left_outer_join(spark):
    one = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    many = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (None, "n")], "m int, w string")
    want = one.join(many, F.col("k") == F.col("m"), "left")
    for hot_keys in (None, hot_of(many, "m", 1)):
        got = left_join_one_to_many(one, many, "k", "m", hot_keys)
        assert got.columns == want.columns
        assert values(got) == values(want)


def test_hot_key_on_the_right_of_a_left_outer_join_is_spread(spark, conf):
    conf(NO_HELP)
    one = spark.range(30_000).select(F.col("id").alias("o"))
    many = hot(spark, 300_000, 7, 20_000)
    joined = left_join_one_to_many(one, many, "o", "k", hot_of(many, "k", 5_000))
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 310_000
    assert max(sizes) < 2 * 310_000 / 16


def hot_of(df, key, hot_rows):
    return HotKeys.of(count_hot_keys(df, [key], hot_rows), hot_rows).get(key)


def hot(spark, rows, hot_key, other_keys):
    """`rows` rows, a third of them with the one key."""
    key = F.when(F.col("id") % 3 == 0, hot_key).otherwise(F.col("id") % other_keys)
    return spark.range(rows).select(key.alias("k"), "id")


def test_hot_key_is_split_though_the_other_side_is_a_join(spark, conf):
    conf({**SPLIT_SMALL, "spark.sql.shuffle.partitions": "16"})
    left = spark.range(20_000).select(F.col("id").alias("k"), F.lit("a").alias("a"))
    one = left.join(left.select("k", F.lit("b").alias("b")), "k")
    many = hot(spark, 300_000, 7, 20_000)
    joined = join_many_to_one(many, one, "k")
    assert joined.count() == 300_000
    assert "SortMergeJoin(skew=true)" in plan_after_run(joined)


def test_fact_with_a_hot_order_and_a_hot_seller(spark, conf):
    conf({**SPLIT_SMALL, "spark.sql.shuffle.partitions": "16"})
    n = 300_000
    items = hot(spark, n, 0, 20_000).select(
        F.col("k").alias("order_id"),
        F.col("id").cast("int").alias("order_item_id"),
        (F.col("id") % 500).alias("product_id"),
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 300).alias("seller_id"),
        ((F.col("id") % 1000) / 100).alias("price"),
        F.lit(1.25).alias("freight_value"),
    )
    ids = spark.range(20_000)
    orders = ids.select(
        F.col("id").alias("order_id"),
        (F.col("id") % 3000).alias("customer_id"),
        F.lit("ok").alias("order_status"),
        F.expr("timestamp_ntz'2020-01-01 10:00:00' + make_dt_interval(cast(id % 400 AS int))").alias(
            "order_purchase_timestamp"
        ),
    )
    payments = ids.select(
        F.col("id").alias("order_id"),
        F.lit(1).alias("payment_sequential"),
        F.lit("card").alias("payment_type"),
        F.lit(2).alias("payment_installments"),
        F.lit(9.5).alias("payment_value"),
    )
    reviews = ids.select(
        F.col("id").alias("review_id"),
        F.col("id").alias("order_id"),
        F.lit("4").alias("review_score"),
        F.lit("m").alias("review_comment_message"),
    )
    fact = gold.fact_sales(
        silver.orders(orders),
        silver.order_items(items),
        silver.payments(payments),
        silver.order_reviews(reviews),
        spark.range(3000).select(F.col("id").alias("customer_id")),
        spark.range(500).select(F.col("id").alias("product_id")),
        silver.sellers(spark.range(300).select(F.col("id").alias("seller_id"))),
        gold.dim_date(silver.date(orders)),
    )
    total = fact.groupBy().agg(F.count("*"), F.countDistinct("order_item_id"), F.sum(F.expr("order_id = 0").cast("int")))
    hot_rows = items.filter("order_id = 0").count()
    assert tuple(total.first()) == (n, n, hot_rows)
    skewed = [line for line in plan_after_run(fact).splitlines() if "skew=true" in line]
    assert any("order_id" in line for line in skewed)
    assert any("seller_id" in line for line in skewed)


def test_customers_with_a_hot_zip(spark, conf):
    conf({**SPLIT_SMALL, "spark.sql.shuffle.partitions": "16"})
    customers = hot(spark, 300_000, 7, 20_000).select(
        F.col("id").alias("customer_id"),
        F.col("k").cast("int").alias("customer_zip_code_prefix"),
        F.lit("x").alias("customer_city"),
    )
    points = spark.range(40_000).select(
        (F.col("id") % 20_000).cast("int").alias("geolocation_zip_code_prefix"),
        (-F.col("id") / 1000).alias("geolocation_lat"),
        F.lit(-50.0).alias("geolocation_lng"),
        F.lit("c").alias("geolocation_city"),
        F.lit("s").alias("geolocation_state"),
    )
    located = gold.dim_customer(customers, points)
    total = located.agg(F.count("*"), F.count("customer_lat"), F.countDistinct("customer_id"))
    assert tuple(total.first()) == (300_000, 300_000, 300_000)
    skewed = [line for line in plan_after_run(located).splitlines() if "skew=true" in line]
    assert any("_zip" in line for line in skewed)


def test_star_queries_sum_before_they_join(layers):
    fact, orders = layers["gold", "fact_sales"], layers["gold", "dim_order"]
    plan = star.revenue_by_payment_type(fact, orders)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert any("Aggregate" in line and "order_id" in line for line in lines[join:])


def test_no_cross_join_or_python_in_any_layer(spark):
    import __spark_entry__ as entry

    for name in [*gold.TABLES, *(f"silver_{t}" for t in silver.TABLES)]:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ExistingRDD"):
            assert bad not in plan, (name, bad)


def test_scans_read_only_the_columns_needed(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["dim_review"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<review_id:bigint,review_score:int>" in plan
    plan = entry.queries()["q_revenue_by_month"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<date_key:int,price:double>" in plan
    box = entry.queries()["silver_geolocation"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<s_suppkey:bigint,s_name:string,s_nationkey:int,s_acctbal:double>" in box

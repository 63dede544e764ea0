"""Rows clustered by several columns: what a filter on any of them has to read."""

import pytest
from pyspark.sql import functions as F

from starloom.operators.layout import bounds, clustered
from starloom.plans import jobs
from tests.test_incremental import lakehouse, put
from tests.test_pipeline import FILES

COLUMNS = ["day", "product", "seller"]


@pytest.fixture(scope="module")
def sales(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sales") / "sales")
    rows = spark.range(200_000).select(
        (F.lit(20_200_000) + F.pmod(F.xxhash64("id"), F.lit(365))).cast("int").alias("day"),
        F.md5(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(5000)).cast("string")).alias("product"),
        F.concat(F.lit("s"), F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(700)).cast("string")).alias("seller"),
        (F.col("id") % 977).alias("price"),
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


def share_of_files(df, column, value):
    """Of the files, those whose statistics do not exclude the value."""
    per_file = df.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    hit, n = per_file.agg(F.count(F.when((F.col("low") <= value) & (F.col("high") >= value), 1)), F.count("*")).first()
    return hit / n, n


def test_a_filter_on_any_column_reads_few_files(spark, sales, tmp_path):
    clustered(sales, COLUMNS, files=64).write.parquet(str(tmp_path / "z"))
    laid = spark.read.parquet(str(tmp_path / "z"))
    assert laid.count() == sales.count() and laid.exceptAll(sales).isEmpty()
    for column in COLUMNS:
        shares = []
        for value in [r[0] for r in sales.select(column).distinct().orderBy(F.xxhash64(column)).limit(5).collect()]:
            share, n = share_of_files(laid, column, value)
            assert 60 <= n <= 70
            shares.append(share)
            assert share_of_files(sales, column, value)[0] == 1
        assert max(shares) <= 0.3  # 64 files cut each of three columns into 4 ranges
    sizes = [r.n for r in laid.groupBy("_metadata.file_name").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 2 * 200_000 / 64


def test_hot_and_odd_values(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, null, 'one') AS a", "id % 4 AS b", "id AS c")
    clustered(rows, ["a", "b"], files=8).write.parquet(str(tmp_path / "hot"))
    laid = spark.read.parquet(str(tmp_path / "hot"))
    assert laid.count() == 20_000
    sizes = [r.n for r in laid.groupBy("_metadata.file_name").agg(F.count("*").alias("n")).collect()]
    assert 7 <= len(sizes) <= 9 and max(sizes) < 4_000
    assert clustered(rows.limit(0), ["a", "b"], files=8).collect() == []
    with pytest.raises(ValueError, match="63"):
        clustered(rows, ["a", "b", "c"], files=8, bits=30)


def test_clustered_fact(spark, tmp_path):
    """The load's fact is the same, and nothing is left of what it was made from."""
    for source, text in FILES.items():
        put(tmp_path, source, "a.csv", text)
    lake = lakehouse(spark)
    jobs.run_all(lake, str(tmp_path))
    plain = sorted(map(str, lake.read("gold", "fact_sales").collect()))
    records = jobs.run_gold(lake, cluster_fact_by=["date_key", "product_id", "seller_id"], fact_files=4)
    assert records[-1]["table"] == "fact_sales" and records[-1]["row_count"] == len(plain) > 0
    assert sorted(map(str, lake.read("gold", "fact_sales").collect())) == plain
    assert spark.sql(f"SHOW TABLES IN {lake.schema_name('gold')} LIKE '*unordered*'").count() == 0


def test_bounds(spark):
    df = spark.createDataFrame([(x,) for x in [*range(100), *[5] * 1000, None]], "v int")
    assert bounds(df, "v", 4) == [25, 50, 75]
    assert bounds(df.filter("v < 2"), "v", 4) == [0, 1]
    assert bounds(df.filter("v IS NULL"), "v", 4) == []

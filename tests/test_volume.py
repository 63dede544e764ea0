"""What queries shuffle and write."""

from pathlib import Path

import __spark_entry__ as entry
from starloom.plans import ask, bronze
from tests.conftest import TESTDATA
from testbed.lake import loaded_lakehouse, new_lakehouse


def shuffled(spark):
    """Bytes that the application has shuffled so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    executors = context.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def shuffled_twice(spark, name):
    sf_dir, found = f"{TESTDATA}/./sf0.001", []  # a path of its own: no other query has loaded it
    for _ in range(2):
        before = shuffled(spark)
        entry.queries()[name](spark, sf_dir)
        found.append(shuffled(spark) - before)
    return found


def test_the_clustered_fact_costs_the_same_whatever_ran_before(spark):
    """It took the whole load where it came first, and a few hundredths of that where it did not."""
    first, again = shuffled_twice(spark, "fact_sales_clustered")
    assert again > 0.9 * first > 0


def test_what_the_load_writes_is_compressed(spark):
    root = Path(loaded_lakehouse(spark, f"{TESTDATA}/sf0.001").location)
    tables = list(root.rglob("part-*.parquet"))
    assert tables and all(".zstd." in p.name for p in tables)
    reviews = f"{bronze.SOURCES['order_reviews'].table}.csv"  # read by byte ranges
    files = list((root / "csv").rglob("part-*"))
    assert len({p.parent.name for p in files}) == len(bronze.SOURCES)
    assert all((p.suffix == ".gz") != (p.parent.name == reviews) for p in files)


def test_the_third_page_costs_the_same_whatever_ran_before(spark):
    first, again = shuffled_twice(spark, "answer_third_page")
    assert again > 0.9 * first > 0


def test_a_page_shuffles_pages_not_the_rows_that_follow(spark):
    """The first page shuffled 3.1 MB before."""
    lake = new_lakehouse(spark, "long_answer")
    lake.create_layer("gold")
    lake.write("gold", "t", spark.range(0, 200_000, 1, 8).selectExpr("xxhash64(id) AS a", "id div 2 AS b"))
    cursor, rows = None, []
    for _ in range(3):
        before = shuffled(spark)
        got = ask.page(lake, "SELECT b, a FROM t", 50, cursor)
        assert shuffled(spark) - before < 100_000
        cursor = got["cursor"]
        rows += got["rows"]
    whole = ask.gold_sql(lake, "SELECT b, a FROM t ORDER BY b, a LIMIT 150")
    assert rows == [r.asDict() for r in whole.collect()]

"""Read-only SQL on the gold layer."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import AnalysisException

import __spark_entry__ as entry
from starloom.plans import ask
from testbed.lake import new_lakehouse


@pytest.fixture(scope="module")
def lake(spark):
    lake = new_lakehouse(spark, "ask")
    lake.create_layer("gold")
    lake.write("gold", "fact_sales", spark.range(20).selectExpr("id", "id * 1.5D AS price"))
    return lake


@pytest.mark.parametrize(
    "sql",
    [
        "select 1",
        "SELECT 1;",
        "```sql\nselect 1;\n```",
        "with q as (select 1 as a) select a from q",
        "select ';'",
        "select 'drop table x'",
        "-- how many\nselect count(*) from fact_sales",
        "/* all */ select id from fact_sales order by id -- done",
        "select f.id from fact_sales f join fact_sales g using (id)",
        "select transform(array(1), x -> x + 1)",
        "from fact_sales |> where id > 3",
        "select id, count(*) over (partition by price) n from fact_sales group by id, price having id > 1 limit 3",
        "select * from fact_sales where id in (select max(id) from fact_sales) or exists (select 1)",
        "select e from fact_sales lateral view explode(array(id)) x as e",
        "select * from range(3)",
        "with recursive r(n) as (select 1 union all select n + 1 from r where n < 5) select * from r",
        "table fact_sales",
    ],
)
def test_accepted(lake, sql):
    assert len(ask.gold_sql(lake, sql).collect()) >= 1


@pytest.mark.parametrize(
    "sql",
    [
        "drop table fact_sales",
        "select 1; select 2",
        "select 1; drop table fact_sales",
        "with q as (select 1) insert into fact_sales select 1, 2.0 from q",
        "insert into fact_sales values (1, 2.0)",
        "select 1) t; drop table fact_sales --",
        "create table t as select 1",
        "show tables",
        "-- select\ndrop table fact_sales",
        "select transform(id) using 'cat' as (x) from fact_sales",
        "select reflect('java.lang.System', 'lineSeparator')",
        "select java_method('java.lang.System', 'lineSeparator')",
        "",
        "select `reflect`('java.lang.System', 'lineSeparator')",
        "select system.builtin.reflect('java.lang.System', 'lineSeparator')",
        "select IDENTIFIER('refl' || 'ect')('java.lang.System', 'lineSeparator')",
        "select id from fact_sales order by try_reflect('java.lang.System', 'lineSeparator')",
        r"select r'\', reflect('java.lang.System', 'lineSeparator') -- '",
        "select transform(id) using r'cat' as (x) from fact_sales",
        "select * from text.`/etc/hostname`",
        "select * from parquet.`/root/testdata/sf0.001/region.parquet`",
        "select * from default.fact_sales",
        "select * from IDENTIFIER('fact' || '_sales')",
        "explain select 1",
        "set spark.sql.ansi.enabled",
        "execute immediate 'drop table fact_sales'",
        "begin select 1; end",
        "declare x int",
    ],
)
def test_refused(lake, sql):
    with pytest.raises(ValueError, match="SELECT"):
        ask.gold_sql(lake, sql)
    assert lake.read("gold", "fact_sales").count() == 20


def test_unknown_names_are_spark_errors(lake):
    with pytest.raises(AnalysisException, match="nope"):
        ask.gold_sql(lake, "select nope from fact_sales")


def test_current_schema_is_restored(spark, lake):
    before = spark.catalog.currentDatabase()
    ask.gold_sql(lake, "select id from fact_sales")
    with pytest.raises(ValueError):
        ask.gold_sql(lake, "drop table fact_sales")
    assert spark.catalog.currentDatabase() == before


def test_catalog_name_of_the_contract(lake):
    assert ask.gold_sql(lake, "select id from iceberg.gold.fact_sales f").count() == 20


def test_back_quoted_catalog_name_and_literals(lake):
    assert ask.gold_sql(lake, "select id from `iceberg`.`gold`.`fact_sales`").count() == 20
    sql = """select 'iceberg.gold.x' a, "iceberg.gold.y" b, r'iceberg.gold.z\\' c -- iceberg.gold.w"""
    assert tuple(ask.gold_sql(lake, sql).first()) == ("iceberg.gold.x", "iceberg.gold.y", "iceberg.gold.z\\")


def test_each_lakehouse_has_its_own_current_schema(spark):
    lakes = []
    for i in range(2):
        lake = new_lakehouse(spark, f"ask_{i}")
        lake.create_layer("gold")
        lake.write("gold", "t", spark.range(i, i + 1))
        lakes.append(lake)
    with ThreadPoolExecutor(8) as pool:
        found = list(pool.map(lambda k: ask.gold_sql(lakes[k % 2], "select id from t").first()[0], range(40)))
    assert found == [0, 1] * 20


def test_whole_result_and_capped_answer(lake):
    sql = "select id, price from fact_sales order by id;"
    assert ask.gold_sql(lake, sql).count() == 20
    assert ask.answer(lake, sql, max_rows=3) == {
        "sql": "select id, price from fact_sales order by id",
        "rows": [{"id": 0, "price": 0.0}, {"id": 1, "price": 1.5}, {"id": 2, "price": 3.0}],
        "columns": ["id", "price"],
        "truncated": True,
    }
    assert ask.answer(lake, sql, max_rows=20)["truncated"] is False
    whole = ask.answer(lake, sql)
    assert (len(whole["rows"]), whole["truncated"]) == (20, False)
    assert ask.ROW_LIMIT == 5000


def test_whole_answer_does_not_pass_the_driver(spark, monkeypatch):
    lake = new_lakehouse(spark, "ask_rows")
    lake.create_layer("gold")
    columns = "order_id order_item_id product_id seller_id review_id price".split()
    lake.write("gold", "fact_sales", spark.range(50).selectExpr(*[f"id AS {c}" for c in columns]))
    monkeypatch.setattr(entry, "loaded_lakehouse", lambda *_: lake)

    def fetched(*_, **__):
        raise AssertionError("rows were fetched")

    with monkeypatch.context() as m:
        for name in ("toLocalIterator", "collect"):
            m.setattr(type(spark.range(0)), name, fetched)
        answer = ask.answer(lake, "select order_id from fact_sales order by order_id")
        table = entry.answer_rows(spark, "unused")
    assert answer["columns"] == ["order_id"]
    assert (len(answer["rows"]), list(answer["rows"])[49]) == (50, {"order_id": 49})
    assert answer["rows"] == [{"order_id": i} for i in range(50)]
    assert answer["rows"] != [{"order_id": i} for i in range(49)]
    assert (table.columns, table.count()) == (columns, 50)


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Repeated rows, nulls, NaN, times of microseconds, long decimals, arrays."""
    lake = new_lakehouse(spark, "pages")
    lake.create_layer("gold")
    rows = spark.range(60).selectExpr(
        "if(id % 7 = 0, null, id % 5) AS a",
        "CASE id % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN null WHEN 2 THEN -1.5D ELSE 0.1D + id % 3 END AS `b c`",
        "timestamp_micros(1500000000000000 + id % 6) AS t",
        "timestamp_ntz'2020-01-01 00:00:00.000001' + make_interval(0, 0, 0, id % 2) AS n",
        "cast('12345678901234567890123456.' || id % 3 AS decimal(38, 5)) AS d",
        "array(id % 2, null) AS l",
        "if(id % 3 = 0, null, 'x\"' || chr(int(233 + id % 2))) AS s",
        "date'2020-01-01' AS day",
    )
    lake.write("gold", "odd", rows.union(rows.filter("a = 1")).union(rows.limit(9)))
    return lake


@pytest.mark.parametrize("size", [5, 50, 1000])
@pytest.mark.parametrize("order_by", [(), ("s", "t")])
def test_pages_are_the_whole_result(odd_rows, size, order_by):
    cursor, pages = None, []
    while True:
        got = ask.page(odd_rows, "SELECT * FROM odd", size, cursor, order_by)
        pages.append(got["rows"])
        cursor = got["cursor"]
        if cursor is None:
            break
    assert all(len(p) == size for p in pages[:-1]) and len(pages[-1]) < size
    assert got["columns"] == ["a", "b c", "t", "n", "d", "l", "s", "day"]
    listed = [str(r) for p in pages for r in p]
    frame = ask.gold_sql(odd_rows, "SELECT * FROM odd")
    whole = frame.orderBy(*order_by, *[f"`{c}`" for c in frame.columns if c not in order_by])
    assert listed == [str(r.asDict(recursive=True)) for r in whole.collect()]


def test_page_of_equal_rows(spark):
    lake = new_lakehouse(spark, "equal_rows")
    lake.create_layer("gold")
    lake.write("gold", "t", spark.range(2500).selectExpr("id % 2 AS n"))
    sizes, cursor = [], None
    for _ in range(6):
        got = ask.page(lake, "SELECT n FROM t", 600, cursor)
        sizes.append((len(got["rows"]), sum(r["n"] for r in got["rows"])))
        cursor = got["cursor"]
        if cursor is None:
            break
    assert sizes == [(600, 0), (600, 0), (600, 550), (600, 600), (100, 100)]


def test_pages_that_cannot_be(lake):
    with pytest.raises(ValueError, match="at least one row"):
        ask.page(lake, "SELECT 1 AS a", 0)
    with pytest.raises(ValueError, match="different names"):
        ask.page(lake, "SELECT 1 AS a, 2 AS a")
    with pytest.raises(ValueError, match="order by"):
        ask.page(lake, "SELECT 1 AS a", order_by=["b"])
    assert ask.page(lake, "SELECT id FROM fact_sales WHERE id < 0") == {
        "sql": "SELECT id FROM fact_sales WHERE id < 0", "rows": [], "columns": ["id"], "cursor": None,
    }


def test_remote_sessions_are_told(lake, monkeypatch):
    monkeypatch.setattr(ask, "_session", lambda _: object())
    with pytest.raises(ValueError, match="remote session"):
        ask.gold_sql(lake, "SELECT 1")

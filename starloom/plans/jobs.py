"""The load jobs: each layer is read from the written tables of the one before."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame

from starloom.operators.layout import clustered
from starloom.plans import bronze, gold, rollup, silver
from starloom.sources.tables import Lakehouse

logger = logging.getLogger(__name__)

LoadRecords = list[dict[str, Any]]

# Tables of a layer that do not read each other are loaded this many at a time, so that
# the last tasks of one leave no executors idle.
TABLES_AT_ONCE = 4


def load_tables(load: Callable[[str], Any], tables: Iterable[str]) -> list[Any]:
    """`load` of each table, `TABLES_AT_ONCE` at a time."""
    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        return list(pool.map(load, tables))


def run_bronze(
    lake: Lakehouse,
    source_dir: str,
    types: Mapping[str, Mapping[str, str]] | None = None,
    infer_schema: bool = False,
) -> LoadRecords:
    """Ingest the nine sources; `types` overrides column types by source name."""
    lake.create_layer("bronze")
    types = types or {}
    return load_tables(
        lambda name: bronze.ingest(lake, name, source_dir, types.get(name), infer_schema),
        bronze.SOURCES,
    )


def run_silver(
    lake: Lakehouse, order_buckets: int | None = None, read: Callable[[str], DataFrame] | None = None
) -> LoadRecords:
    """Clean the bronze tables, or the sources that `read` gives by name where they are no CSV files.

    `order_buckets` buckets the tables that have one row per order by it, so that gold joins them
    without a shuffle. Take the number of shuffle partitions, or none where files would be tiny.
    """
    lake.create_layer("silver")
    read = read or (lambda source: lake.read("bronze", bronze.SOURCES[source].table))

    def load(table: str) -> dict[str, Any]:
        build, source = silver.TABLES[table]
        bucketed = order_buckets and table in silver.ONE_ROW_PER_ORDER
        return lake.write(
            "silver",
            table,
            build(read(source)),
            bucket_by=(order_buckets, "order_id") if bucketed else None,
        )

    records = load_tables(load, silver.TABLES)
    hot = silver.hot_keys(lake.read("silver", "orders"), lake.read("silver", "order_items"))
    return [*records, lake.write("silver", "hot_keys", hot)]


def run_gold(
    lake: Lakehouse,
    partition_fact_by: Sequence[str] = (),
    properties: Mapping[str, str] | None = None,
    cluster_fact_by: Sequence[str] = (),
    fact_files: int = 512,
) -> LoadRecords:
    """Build the dimensions, then the fact from the written dimensions. `properties`: as in `Lakehouse.write`.

    `partition_fact_by=["date_key"]` lets queries on a time range skip the other days' files;
    it pays off when a day's sales fill at least a file. `cluster_fact_by=["date_key", "product_id", "seller_id"]`
    serves filters on any of these (`operators/layout.py`) with about `fact_files` files, at the price of writing the
    fact twice.
    """
    lake.create_layer("gold")

    def load(table: str, partition_by: Sequence[str] = ()) -> dict[str, Any]:
        build, inputs = gold.TABLES[table]
        rows = build(*[lake.read(*name) for name in inputs])
        return lake.write("gold", table, rows, partition_by, properties=properties)

    dimensions = load_tables(load, [table for table in gold.TABLES if table != "fact_sales"])
    if not cluster_fact_by:
        return [*dimensions, load("fact_sales", partition_fact_by)]
    # the bounds of the columns come from the written rows
    build, inputs = gold.TABLES["fact_sales"]
    lake.write("gold", "fact_sales_unordered", build(*[lake.read(*name) for name in inputs]))
    rows = clustered(lake.read("gold", "fact_sales_unordered"), cluster_fact_by, fact_files)
    fact = lake.write("gold", "fact_sales", rows, partition_fact_by, properties=properties)
    lake.drop("gold", "fact_sales_unordered")
    return [*dimensions, fact]


def run_rollups(lake: Lakehouse, properties: Mapping[str, str] | None = None) -> LoadRecords:
    """Build the roll-ups of the fact, beside it in gold. `properties`: as in `Lakehouse.write`."""

    def load(table: str) -> dict[str, Any]:
        build, inputs = rollup.TABLES[table]
        return lake.write("gold", table, build(*[lake.read("gold", name) for name in inputs]), properties=properties)

    return load_tables(load, rollup.TABLES)


def run_all(
    lake: Lakehouse,
    source_dir: str,
    layers: Sequence[str] = ("bronze", "silver", "gold"),
    types: Mapping[str, Mapping[str, str]] | None = None,
    infer_schema: bool = False,
    order_buckets: int | None = None,
    partition_fact_by: Sequence[str] = (),
) -> dict[str, LoadRecords]:
    """Run the layers in order, "rollups" among them if wanted; a failure is logged and stops the run."""
    steps = {
        "bronze": lambda: run_bronze(lake, source_dir, types, infer_schema),
        "silver": lambda: run_silver(lake, order_buckets),
        "gold": lambda: run_gold(lake, partition_fact_by),
        "rollups": lambda: run_rollups(lake),
    }
    records = {}
    for layer in layers:
        logger.info("Starting the %s layer", layer)
        try:
            records[layer] = steps[layer]()
        except Exception:
            logger.exception("The %s layer failed", layer)
            raise
        for record in records[layer]:
            logger.info("%s.%s: %d rows", layer, record["table"], record["row_count"])
    return records


def layer_tables() -> list[tuple[str, str]]:
    """All (layer, table) pairs that the jobs write."""
    return (
        [("bronze", source.table) for source in bronze.SOURCES.values()]
        + [("silver", table) for table in silver.TABLES]
        + [("gold", table) for table in gold.TABLES]
    )

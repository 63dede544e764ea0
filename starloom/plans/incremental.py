"""Loads that read new source files only and clean only what these files touch.

Which files a bronze table consists of is kept in the table `bronze.source_files`: source, part of the table, path,
length, time of modification and a checksum of the lines. A row counts if its part is one of the table's parts. The
rows are written before the part is published: after a failure in between the file is new again, and its
stale row is passed over. Likewise each silver table keeps with it which parts of bronze it was made of, and
the fact which of silver, so a load that broke off is taken up where it did.

* New files are read and become one more part of the table. A table of `MOST_PARTS` parts is loaded in full, and
  one whose types are inferred always.
* A file that has vanished, or whose lines have changed, makes its source a full load. One that was only touched
  (same length and checksum, another time) stays as it is. In multi-line files the order of lines matters,
  which the checksum does not see, so there a touched file counts as changed.
* A silver builder never merges rows of different values of its table's `KEYS`. So only the values in the new rows are
  cleaned anew, from all bronze rows that have them. If none has a silver row yet, what comes out is appended;
  else it replaces the rows of these values, and the others are copied without a shuffle. Where `FULL_SHARE` of all
  rows is new, the whole table is cleaned once instead.
* Gold is built anew if any silver table has changed, the roll-ups of the fact if they are kept.
"""

from __future__ import annotations

import hashlib
import logging
import threading
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.plans import bronze, jobs, rollup, silver
from starloom.sources.csv_files import Paths
from starloom.sources.tables import MOST_PARTS, Lakehouse

logger = logging.getLogger(__name__)

LEDGER = "source_files"
#: If so large a share of a bronze table's rows is new, and so many are, cleaning all rows once costs less than finding
#: and replacing those that the new ones touch.
FULL_SHARE, LEAST_ROWS = 0.25, 100_000
_adding = threading.Lock()
FILES_SCHEMA = "path string, uri string, length long, modified timestamp"
LEDGER_SCHEMA = f"source string, part string, {FILES_SCHEMA}, checksum long"

#: Silver table -> the column whose values keep its rows apart, in bronze and in silver.
KEYS = {
    "customers": "customer_id",
    "sellers": "seller_id",
    "products": "product_id",
    "order_items": "order_id",
    "payments": "order_id",
    "order_reviews": "order_id",
    "product_category": "product_category_name",
    "orders": "order_id",
    "date": "order_purchase_timestamp",
    "geolocation": "geolocation_zip_code_prefix",
}


def listing(spark: SparkSession, path: Paths) -> DataFrame:
    """path, uri (the same, encoded), length, modified of the files, as they are now; their content is not read."""
    files = spark.read.format("binaryFile").load(path)
    uri, modified = F.col("_metadata.file_path").alias("uri"), F.col("modificationTime").alias("modified")
    rows = files.select("path", uri, "length", modified).collect()
    return spark.createDataFrame(rows, FILES_SCHEMA)


def checksums(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """uri, checksum: a sum over the lines, whatever their order. An empty file has no row."""
    line = F.xxhash64("value").cast("decimal(38,0)")
    total = F.pmod(F.sum(line), F.lit(1 << 62).cast("decimal(38,0)")).cast("long")
    lines = spark.read.text(list(paths), lineSep="\n")
    return lines.groupBy(F.col("_metadata.file_path").alias("uri")).agg(total.alias("checksum"))


def ledger(lake: Lakehouse, source: bronze.Source) -> DataFrame:
    """The files that the source's bronze table consists of."""
    parts = lake.parts("bronze", source.table)
    if not parts or not lake.parts("bronze", LEDGER):
        return lake.spark.createDataFrame([], LEDGER_SCHEMA)
    return lake.read("bronze", LEDGER).filter((F.col("source") == source.table) & F.col("part").isin(parts))


@dataclass(frozen=True)
class Changes:
    """Of a source's files since its last load: the paths to add; or why all are to be loaded."""

    new: tuple[str, ...] = ()
    full: str = ""


def changes(lake: Lakehouse, source: bronze.Source, files: DataFrame) -> Changes:
    """`files` (from `listing`) against the ledger."""
    known = ledger(lake, source)
    if known.isEmpty():
        return Changes(full="first load")
    same_length = F.col("f.length") == F.col("k.length")
    state = (
        F.when(F.col("k.path").isNull(), "new")
        .when(F.col("f.path").isNull(), "gone")
        .when(same_length & (F.col("f.modified") == F.col("k.modified")), "same")
        .when(same_length, "touched")
        .otherwise("changed")
    )
    both = files.alias("f").join(known.alias("k"), F.col("f.path") == F.col("k.path"), "full")
    states = both.select(F.coalesce("f.path", "k.path").alias("path"), "f.uri", state.alias("state"), "k.checksum")
    found: dict[str, list[Any]] = {}
    for row in states.filter("state != 'same'").collect():
        found.setdefault(row.state, []).append(row)
    for kind in ("gone", "changed"):
        if kind in found:
            return Changes(full=f"{found[kind][0].path} is {kind}")
    if touched := found.get("touched"):
        now = {} if source.multiline else {r.uri: r.checksum for r in checksums(lake.spark, [r.path for r in touched]).collect()}
        for row in touched:
            if row.checksum is None or now.get(row.uri) != row.checksum:
                return Changes(full=f"{row.path} is changed")
    new = tuple(sorted(r.path for r in found.get("new", [])))
    if new and len(lake.parts("bronze", source.table)) >= MOST_PARTS:
        return Changes(full=f"{MOST_PARTS} parts")
    return Changes(new)


def load_source(
    lake: Lakehouse, name: str, source_dir: str, types: Mapping[str, str] | None = None, infer_schema: bool = False
) -> dict[str, Any]:
    """Bring one of `bronze.SOURCES` up to date. `files` of the record are the paths read, none if nothing is new."""
    source = bronze.SOURCES[name]
    listed = listing(lake.spark, f"{source_dir.rstrip('/')}/{source.table}.csv")
    found = changes(lake, source, listed)
    if found.new and infer_schema:
        found = Changes(full="types are inferred of all files")
    if not found.full and not found.new:
        return {"table": source.table, "files": [], "full": ""}
    if found.full:
        logger.info("%s: full load, %s", source.table, found.full)
    else:
        listed = listed.filter(F.col("path").isin(list(found.new)))
    paths = [r.path for r in listed.select("path").collect()]

    def note(part: str) -> None:
        sums = lake.spark.createDataFrame([], "uri string, checksum long") if source.multiline else checksums(lake.spark, paths)
        rows = listed.join(sums, "uri", "left").select(
            F.lit(source.table).alias("source"), F.lit(part).alias("part"), "path", "uri", "length", "modified", "checksum"
        )
        with _adding:
            lake.append("bronze", LEDGER, rows)

    record = bronze.ingest(lake, name, source_dir, types, infer_schema, files=paths, add=not found.full, note=note)
    return record | {"files": paths, "full": found.full}


def refresh_silver(lake: Lakehouse, table: str, order_buckets: int | None = None) -> dict[str, Any] | None:
    """Bring a silver table up to date with its bronze table; None if it is."""
    build, source = silver.TABLES[table]
    name, key = bronze.SOURCES[source].table, KEYS[table]
    parts = lake.parts("bronze", name)
    made_of = [p for p in lake.own_properties("silver", table).get("from", "").split(",") if p]
    if made_of == parts:
        return None
    rows, own = lake.read("bronze", name), {"from": ",".join(parts)}
    bucketed = (order_buckets, "order_id") if order_buckets and table in silver.ONE_ROW_PER_ORDER else None
    if not made_of or made_of != parts[: len(made_of)]:
        return lake.write("silver", table, build(rows), bucket_by=bucketed, properties=own) | {"how": "full"}
    added = [lake.read("bronze", p).select(key) for p in parts[len(made_of) :]]
    values = added[0]
    for more in added[1:]:
        values = values.unionByName(more)
    values = values.dropna().distinct()
    n_added = sum(lake.read("bronze", p).count() for p in parts[len(made_of) :])
    if n_added >= LEAST_ROWS and n_added >= FULL_SHARE * rows.count():
        return lake.write("silver", table, build(rows), bucket_by=bucketed, properties=own) | {"how": "full"}
    again = build(rows.join(values, key, "left_semi"))
    old = lake.read("silver", table)
    again = again.select(old.columns)
    if not bucketed and old.join(values, key, "left_semi").isEmpty():
        return lake.append("silver", table, again, properties=own) | {"how": "appended"}
    both = old.join(values, key, "left_anti").unionByName(again)
    return lake.write("silver", table, both, bucket_by=bucketed, properties=own) | {"how": "merged"}


def run_incremental(
    lake: Lakehouse,
    source_dir: str,
    types: Mapping[str, Mapping[str, str]] | None = None,
    infer_schema: bool = False,
    order_buckets: int | None = None,
    partition_fact_by: Sequence[str] = (),
    silver_tables: Collection[str] | None = None,
) -> dict[str, jobs.LoadRecords]:
    """Bring all layers up to date with the source files. The tables are those of `jobs.run_all` over all the files,
    whose parameters these are. Layers of which nothing changes are not written and have no records, but for bronze:
    one per source, with the files read.

    `silver_tables`: bring these alone, and the sources they are made of, up to date. Gold then stays as it is.
    """
    types = types or {}
    tables = [t for t in silver.TABLES if silver_tables is None or t in silver_tables]
    sources = [s for s in bronze.SOURCES if silver_tables is None or s in {silver.TABLES[t][1] for t in tables}]
    for layer in ("bronze", "silver"):
        lake.create_layer(layer)
    load = lambda name: load_source(lake, name, source_dir, types.get(name), infer_schema)
    records = {"bronze": jobs.load_tables(load, sources)}
    made = jobs.load_tables(lambda table: refresh_silver(lake, table, order_buckets), tables)
    records["silver"] = [r for r in made if r]
    if silver_tables is not None:
        return records
    versions = ",".join(p for table in silver.TABLES for p in lake.parts("silver", table))
    now = {"from": hashlib.md5(versions.encode()).hexdigest()}
    if lake.own_properties("gold", "fact_sales") != now:
        hot = silver.hot_keys(lake.read("silver", "orders"), lake.read("silver", "order_items"))
        records["silver"].append(lake.write("silver", "hot_keys", hot))
        records["gold"] = jobs.run_gold(lake, partition_fact_by, now)
    kept = lake.spark.catalog.tableExists(lake.table_name("gold", "sales_rollup"))
    if kept and any(lake.own_properties("gold", table) != now for table in rollup.TABLES):
        records["gold"] = [*records.get("gold", []), *jobs.run_rollups(lake, now)]
    return records

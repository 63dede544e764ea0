"""Layer tables: one schema per layer, whole-table replace, load records.

A table of plain files is a view of one or more written tables, its parts. A load writes a new part beside those
in use and replaces the view in one statement, so readers have the old rows or the new ones, never none and
never some of both; those still on the old parts keep them for as many loads as `keep_versions` says.
The view's properties name its parts, and those before. One process at a time loads a table.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

logger = logging.getLogger(__name__)

#: Formats whose tables are plain files: replacing one in place would first drop it.
FILE_FORMATS = ("parquet", "orc", "csv", "json")

#: Parquet's own default, snappy, makes about a third more of the same tables.
WRITE_OPTIONS = {"parquet": {"compression": "zstd"}}

#: A table to which rows are appended is written as one again when it would have more parts.
MOST_PARTS = 32
_PARTS, _BEFORE, _OWN = "starloom.parts", "starloom.before", "starloom.own."


@dataclass(frozen=True)
class Lakehouse:
    """Where the layers `bronze`, `silver` and `gold` live.

    `location`: root folder of the layers; None leaves it to the catalog's warehouse.
    `catalog`:  catalog name in front of the schema; None is the session's own catalog.
    `prefix`:   put before each schema name, to keep several lakehouses in one catalog.
    `fmt`:      table format, any that the session has on its classpath.
    `keep_versions`: how many versions of a table of files there are, the current one included.
    """

    spark: SparkSession
    location: str | None = None
    catalog: str | None = None
    prefix: str = ""
    fmt: str = "parquet"
    keep_versions: int = 2

    def schema_name(self, layer: str) -> str:
        schema = f"`{self.prefix}{layer}`"
        return f"`{self.catalog}`.{schema}" if self.catalog else schema

    def table_name(self, layer: str, table: str) -> str:
        return f"{self.schema_name(layer)}.`{table}`"

    def create_layer(self, layer: str) -> None:
        where = f" LOCATION '{self.location}/{layer}'" if self.location else ""
        self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS {self.schema_name(layer)}{where}")

    def read(self, layer: str, table: str) -> DataFrame:
        return self.spark.table(self.table_name(layer, table))

    def write(
        self,
        layer: str,
        table: str,
        df: DataFrame,
        partition_by: Sequence[str] = (),
        bucket_by: tuple[int, str] | None = None,
        count: Mapping[str, Column] | None = None,
        then: Sequence[Column] = (),
        note: Callable[[str], None] | None = None,
        properties: Mapping[str, str] | None = None,
    ) -> dict[str, Any]:
        """Replace the table by `df` and return its load record.

        `partition_by`: folders by these columns. Rows are first rebalanced on them: adaptive
        execution then writes few files per folder and splits one far larger than the rest.
        `bucket_by`: (n, column), for a column without hot values. Tables with the same buckets
        join on it without a shuffle. One file per bucket; where `df` is already hashed on the
        column into n partitions, Spark leaves the repartitioning out.
        `count`: aggregates over `df` for the record's `rejected`; `then`: columns to write instead
        of all. `note` is called with the name of what was written before readers see it; `properties` are kept
        with this version of the table (`own_properties`). Both are for tables of files.

        The rows are counted as they are written. A table of files becomes a new version, so that readers have the
        old one until the new one is whole and a failed load leaves it.
        """
        return self._load(layer, table, df, partition_by, bucket_by, count, then, note, properties, append=False)

    def append(
        self,
        layer: str,
        table: str,
        df: DataFrame,
        count: Mapping[str, Column] | None = None,
        then: Sequence[Column] = (),
        note: Callable[[str], None] | None = None,
        properties: Mapping[str, str] | None = None,
    ) -> dict[str, Any]:
        """Add rows to a table, or begin it with them, and return the load record.

        A table of files gets one more part; the others are not read, unless it has MOST_PARTS: then all are
        written as one again afterwards. A new part must have the columns of the table.
        """
        return self._load(layer, table, df, (), None, count, then, note, properties, append=True)

    def _load(
        self,
        layer: str,
        table: str,
        df: DataFrame,
        partition_by: Sequence[str],
        bucket_by: tuple[int, str] | None,
        count: Mapping[str, Column] | None,
        then: Sequence[Column],
        note: Callable[[str], None] | None,
        properties: Mapping[str, str] | None,
        append: bool,
    ) -> dict[str, Any]:
        observed = Observation()
        counts = [F.count(F.lit(1)).alias("rows"), *[c.alias(f"rejected.{k}") for k, c in (count or {}).items()]]
        df = df.observe(observed, *counts)
        if then:
            df = df.select(*then)
        name = self.table_name(layer, table)
        present = append and self.spark.catalog.tableExists(name)
        if present and (columns := self.read(layer, table).columns) != df.columns:
            raise ValueError(f"{name} has the columns {columns}, the new rows {df.columns}")
        if partition_by:
            df = df.hint("rebalance", *partition_by)
        if bucket_by:
            df = df.repartition(*bucket_by)
        writer = df.write.format(self.fmt).mode("append" if present else "overwrite")
        writer = writer.options(**WRITE_OPTIONS.get(self.fmt, {}))
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if bucket_by:
            writer = writer.bucketBy(*bucket_by)

        part = None
        if self.fmt in FILE_FORMATS:
            part = f"{table}__v{time.time_ns():020d}_{uuid.uuid4().hex[:4]}"
            writer.mode("overwrite").saveAsTable(self.table_name(layer, part))
            if note:
                note(part)
            parts = [*(self.parts(layer, table) if present else []), part]
            self._publish(layer, table, parts, df.columns, properties or {})
        else:
            writer.saveAsTable(name)
        metrics = observed.get
        logger.info("%s now has %s rows in %d columns", name, metrics.get("rows"), len(df.columns))
        record = {
            "table": table,
            "row_count": metrics.get("rows", -1),  # -1: Spark reported no metrics
            "column_count": len(df.columns),
            "columns": df.columns,
        }
        if count is not None:
            record["rejected"] = {k: metrics.get(f"rejected.{k}") for k in count}
        if present and part and len(self.parts(layer, table)) > MOST_PARTS:
            self.write(layer, table, self.read(layer, table), properties=properties)
        return record

    def drop(self, layer: str, table: str) -> None:
        """Drop a table, and all versions of a table of files."""
        name = self.table_name(layer, table)
        if self.fmt not in FILE_FORMATS:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            return
        self.spark.sql(f"DROP VIEW IF EXISTS {name}")
        for r in self.spark.sql(f"SHOW TABLES IN {self.schema_name(layer)} LIKE '{table}__v*'").collect():
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table_name(layer, r['tableName'])}")

    def _properties(self, layer: str, table: str) -> dict[str, str]:
        """Of the view of a table of files; empty if there is none."""
        name = self.table_name(layer, table)
        if not self.spark.catalog.tableExists(name):
            return {}
        return {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}

    def parts(self, layer: str, table: str) -> list[str]:
        """The written tables that a table of files consists of."""
        return [p for p in self._properties(layer, table).get(_PARTS, "").split(",") if p]

    def own_properties(self, layer: str, table: str) -> dict[str, str]:
        """What the last load of a table of files gave as its properties."""
        found = self._properties(layer, table).items()
        return {k.removeprefix(_OWN): v for k, v in found if k.startswith(_OWN)}

    def _publish(self, layer: str, table: str, parts: Sequence[str], columns: Sequence[str], own: Mapping[str, str]) -> None:
        """Make the table these parts, and drop versions that are too old."""
        name = self.table_name(layer, table)
        properties = self._properties(layer, table)
        if self._is_plain(layer, table):
            # a table that was written before there were versions becomes the first of them
            first = f"{table}__v{0:020d}_{uuid.uuid4().hex[:4]}"
            self.spark.sql(f"ALTER TABLE {name} RENAME TO {self.table_name(layer, first)}")
            properties = {_PARTS: first}
        versions = [properties.get(_PARTS, ""), *properties.get(_BEFORE, "").split(";")]
        before = [v for v in versions if v][: self.keep_versions - 1]
        listed = ", ".join(f"`{c.replace('`', '``')}`" for c in columns)
        rows = " UNION ALL ".join(f"SELECT {listed} FROM {self.table_name(layer, p)}" for p in parts)
        now = {_PARTS: ",".join(parts), _BEFORE: ";".join(before), **{f"{_OWN}{k}": v for k, v in own.items()}}
        listed_properties = ", ".join(f"'{k}' = '{v}'" for k, v in now.items())
        self.spark.sql(f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ({listed_properties}) AS {rows}")
        kept = {*parts, *[p for v in before for p in v.split(",")]}
        written = self.spark.sql(f"SHOW TABLES IN {self.schema_name(layer)} LIKE '{table}__v*'").collect()
        for old in sorted(r["tableName"] for r in written):
            if old not in kept and old < parts[-1]:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.table_name(layer, old)}")

    def _is_plain(self, layer: str, table: str) -> bool:
        name = self.table_name(layer, table)
        return self.spark.catalog.tableExists(name) and self.spark.catalog.getTable(name).tableType != "VIEW"

    def audit(self, tables: Iterable[tuple[str, str]]) -> DataFrame:
        """One row per (layer, table): its row count, column count and column names."""
        return reduce(DataFrame.unionAll, [self._audit_row(*t) for t in tables])

    def _audit_row(self, layer: str, table: str) -> DataFrame:
        df = self.read(layer, table)
        return df.agg(F.count("*").alias("row_count")).select(
            F.lit(layer).alias("layer"),
            F.lit(table).alias("table_name"),
            "row_count",
            F.lit(len(df.columns)).alias("column_count"),
            F.lit(",".join(df.columns)).alias("columns"),
        )

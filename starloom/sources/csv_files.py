"""CSV scan: all columns as text, typed by column name, or with inferred types."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.casts import typed_columns
from starloom.sources.multiline_csv import multiline_csv

logger = logging.getLogger(__name__)

# A multi-line file whose types are inferred is read by one task. Files above this size are reported.
LARGE_UNSPLITTABLE_BYTES = 1 << 30


#: One path, a folder or pattern included, or several.
Paths = str | Sequence[str]


def table_name_of(path: str) -> str:
    """`/data/orders.csv` -> `orders`."""
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0]


def _options(multiline: bool) -> dict[str, object]:
    options: dict[str, object] = {"header": True}
    if multiline:
        options |= {"multiLine": True, "escape": '"'}
    return options


def _with_required(df: DataFrame, path: Paths, required: Iterable[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}; it has {df.columns}")
    return df


def text_csv(spark: SparkSession, path: Paths, required: Iterable[str] = (), multiline: bool = False) -> DataFrame:
    """Headed CSV file(s) with every column as text. With `multiline`, quoted fields may hold line
    breaks and doubled quotes; a file is read by many tasks in either case."""
    options = _options(multiline)
    header = spark.read.options(**options).csv(path).columns
    if multiline:
        return _with_required(multiline_csv(spark, path, header), path, required)
    schema = ", ".join(f"`{c}` string" for c in header)
    # enforceSchema=False checks each file's header against the schema
    return _with_required(spark.read.schema(schema).options(**options, enforceSchema=False).csv(path), path, required)


def infer_csv(spark: SparkSession, path: Paths, required: Iterable[str] = (), multiline: bool = False) -> DataFrame:
    """The same with types that Spark works out, at the price of a second pass, and with `multiline` by
    one task per file."""
    if multiline:
        _warn_of_large_files(spark, path)
    df = spark.read.options(**_options(multiline), inferSchema=True).csv(path)
    return _with_required(df, path, required)


def read_csv(
    spark: SparkSession,
    path: Paths,
    types: Mapping[str, str] | None = None,
    required: Iterable[str] = (),
    multiline: bool = False,
) -> DataFrame:
    """Headed CSV file(s), types by column name; columns not listed stay text. The data is read once.

    A value that is not of its type is null; `bronze.ingest_csv` counts these.
    """
    text = text_csv(spark, path, required, multiline)
    return text.select(*[v.alias(c) for c, v in typed_columns(types or {}, text.columns).items()])


def _warn_of_large_files(spark: SparkSession, path: Paths) -> None:
    sizes = spark.read.format("binaryFile").load(path).filter(F.col("length") > LARGE_UNSPLITTABLE_BYTES)
    n, total, largest = sizes.agg(F.count("*"), F.sum("length"), F.max_by("path", "length")).first()
    if n:
        logger.warning(
            "%d file(s) of %s, %d bytes together, are one task's work each; the largest is %s. Declare"
            " their types, or deliver them as several files",
            n, path, total, largest,
        )

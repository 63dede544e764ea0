"""Row cleaning: nulls, duplicates, coordinate boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def drop_nulls(df: DataFrame, how: str = "any") -> DataFrame:
    """Drop rows with any null (or, with `how="all"`, only nulls). NaN counts as null."""
    return df.na.drop(how)


def distinct_rows(df: DataFrame) -> DataFrame:
    """One of each row. Copies are merged before the shuffle, so many copies of a row cost little."""
    return df.dropDuplicates()


def dedupe_by_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: the one whose other columns, left to right, are smallest (nulls first).

    Spark applies the limit of one row per key within each task before it shuffles, so a hot
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*rest))
    return df.withColumn("_rank_in_key", rank).filter("_rank_in_key = 1").drop("_rank_in_key")


def first_by_key(order: Sequence[str]) -> Column:
    """Aggregate: the `order` columns, as a struct, of the group's first row in their order."""
    return F.min(F.struct(*order))


def within_box(
    df: DataFrame, lat: str, lng: str, lat_range: tuple[float, float], lng_range: tuple[float, float]
) -> DataFrame:
    """Rows whose point lies in the box, edges included."""
    return df.filter(F.col(lat).between(*lat_range) & F.col(lng).between(*lng_range))

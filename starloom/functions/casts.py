"""Casts that give null for what cannot be cast, whatever the session's ANSI mode."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def int_from_text(text: Column | str) -> Column:
    """'5' -> 5, '3.9' -> 3, '.5' -> 0, 'abc' -> null."""
    # most values match the first pattern, and only the others are held against the second
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)(?:\.\d*)?\s*$", 1)
    fraction = F.regexp_like(text, F.lit(r"^\s*[+-]?\.\d*\s*$"))
    return F.when(digits != "", digits.try_cast("int")).when(fraction, 0)


def int_columns(df: DataFrame, names: Iterable[str]) -> dict[str, Column]:
    """Integer versions of those `names` that `df` has; fractions are cut off."""
    return {
        c: int_from_text(c) if isinstance(df.schema[c].dataType, StringType) else F.col(c).try_cast("int")
        for c in names
        if c in df.columns
    }


def double_columns(df: DataFrame, names: Iterable[str]) -> dict[str, Column]:
    """Those `names` that `df` has as text, as doubles."""
    return {
        c: F.col(c).try_cast("double")
        for c in names
        if c in df.columns and isinstance(df.schema[c].dataType, StringType)
    }


def typed_columns(types: Mapping[str, str], columns: Iterable[str]) -> dict[str, Column]:
    """Text columns by their types; a column without one stays text."""

    def cast(name: str) -> Column:
        kind = types.get(name, "string")
        column = F.col(f"`{name}`")
        return column if kind == "string" else int_from_text(column) if kind == "int" else column.try_cast(kind)

    return {c: cast(c) for c in columns}


def zip_text(zip_code: Column | str) -> Column:
    """A zip code of any type as text that agrees between files: of digits alone, without the
    zeros in front that a reader of numbers loses."""
    text = F.trim(F.col(zip_code).cast("string") if isinstance(zip_code, str) else zip_code.cast("string"))
    return F.regexp_replace(F.regexp_replace(text, r"^(\d+)\.0+$", "$1"), r"^0+(?=\d+$)", "")

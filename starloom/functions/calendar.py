"""Calendar attributes of a date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_key(day: Column | str) -> Column:
    """2017-03-09 -> 20170309."""
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def calendar_columns(day: Column | str) -> dict[str, Column]:
    """Columns of the date dimension; weeks are ISO weeks and days count from Monday = 1."""
    day_of_week = F.weekday(day) + 1
    return {
        "date_key": date_key(day),
        "year": F.year(day),
        "quarter": F.quarter(day),
        "month": F.month(day),
        "day": F.dayofmonth(day),
        "day_of_week": day_of_week,
        "week_of_year": F.weekofyear(day),
        "month_name": F.date_format(day, "MMMM"),
        "day_name": F.date_format(day, "EEEE"),
        "is_weekend": day_of_week.isin(6, 7),
    }

"""Calendar attributes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(value: Column) -> Column:
    """Date, or null where the text is not a date (never throws under ANSI)."""
    return value.try_cast("date")


def date_key(day: Column) -> Column:
    """Integer YYYYMMDD."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def is_weekend(day: Column) -> Column:
    """1 on Saturday and Sunday, else 0 (``dayofweek`` counts 1=Sunday .. 7=Saturday)."""
    return F.when(F.dayofweek(day).isin(1, 7), 1).otherwise(0)


def year_month_label(year: Column, month: Column) -> Column:
    return F.format_string("%d-%02d", year, month)

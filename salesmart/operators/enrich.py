"""Calendar enrichment and column naming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.dates import date_key, is_weekend, parse_date
from salesmart.functions.numeric import round_half_up


def enrich_sales(clean: DataFrame) -> DataFrame:
    """Parsed date (unparseable rows dropped), date parts, weekend flag, revenue to the cent."""
    day = F.col("date")
    dated = clean.withColumn("date", parse_date(day)).filter(day.isNotNull())
    return dated.withColumns(
        {
            "revenue": round_half_up(F.col("sales_quantity") * F.col("price"), 2),
            "year": F.year(day),
            "month": F.month(day),
            "week": F.weekofyear(day),
            "day_of_week": F.dayofweek(day),
            "is_weekend": is_weekend(day),
        }
    )


def date_attributes(df: DataFrame, column: str = "date") -> DataFrame:
    """Distinct days of ``column`` with key, ISO text, parts and weekday (0=Monday)."""
    day = F.col("day_value")
    return (
        df.select(parse_date(F.col(column)).alias("day_value"))
        .filter(day.isNotNull())
        .distinct()
        .select(
            date_key(day).alias("date_id"),
            day.cast("string").alias("full_date"),
            F.year(day).alias("year"),
            F.month(day).alias("month"),
            F.dayofmonth(day).alias("day"),
            F.weekday(day).alias("weekday"),
        )
    )


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip().lower().replace(" ", "_") for c in df.columns))

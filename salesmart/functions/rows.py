"""Whole rows as a few numbers, and scalars over a frame that is read anyway."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(columns: Sequence[Column]) -> list[Column]:
    """Two 64-bit hashes that together name a row.

    Two different rows share both with odds of about 1 to 2**128: below 1e-14 for any
    pair among 1e12 rows. The hash skips nulls, so where they are is hashed as well.
    """
    absent = F.concat(*(F.when(c.isNull(), "1").otherwise("0") for c in columns))
    return [F.xxhash64(absent, *columns), F.xxhash64(F.lit("second"), absent, *columns)]


def scalar_over(df: DataFrame, **aggregates: Column) -> Column:
    """A struct of aggregates over all rows of ``df``, for use in a frame derived from ``df``.

    A scalar subquery that read fewer columns than ``df`` has would be another plan and
    compute its input again. This one reads them all, so that the shuffle below an
    aggregated ``df`` is written once and read twice (``ReusedExchange``).
    """
    whole = F.max(F.xxhash64(*df.columns)).alias("_whole")
    return df.agg(F.struct(*(a.alias(n) for n, a in aggregates.items()), whole).alias("scalars")).scalar()


def word_of(number: Column) -> Column:
    """Which 64 whole numbers a number is among."""
    return F.shiftright(number.cast("bigint"), 6)


def bit_of(number: Column) -> Column:
    """The number's bit in the bitmap of its word; null for null."""
    place = number.cast("bigint").bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)

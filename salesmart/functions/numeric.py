"""Rounding, exact sums and guarded ratios as Column expressions.

Results are compared to the cent, so sums must not depend on the order in which
partitions are merged (or re-run after a lost executor). Money is therefore
summed as whole cents, and integers that may overflow a bigint in sum are summed
in two halves: exact, cheap, code-generated. The halves meet in a 38-digit decimal
once per group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int) -> Column:
    """Round to ``digits`` places, half up on the decimal value.

    Going through DECIMAL(38,9) drops binary noise first (1.005 -> 1.01).
    Doubles too large for that type have no decimals left and pass unchanged.
    """
    exact = F.round(value.try_cast("decimal(38,9)"), digits).cast("double")
    return F.coalesce(exact, value.cast("double"))


def round_half_even(value: Column) -> Column:
    """Round to a whole number, ties to the even neighbour."""
    return F.rint(value).cast("bigint")


def round_whole(value: Column) -> Column:
    """Round to a whole number, ties upwards."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


HALF = 1_000_000_000


def _halves(high: Column, low: Column) -> Column:
    return F.sum(high).cast("decimal(28,0)") * F.lit(HALF).cast("decimal(10,0)") + F.sum(low)


def sum_whole(value: Column) -> Column:
    """Sum of bigints as decimal(38,0), without overflow."""
    high = F.floor(value / F.lit(float(HALF))).cast("bigint")
    return _halves(high, value - high * F.lit(HALF))


def from_cents(value: Column) -> Column:
    return value.cast("double") / F.lit(100)


#: From this many cents on, doubles no longer hold every cent.
EXACT_CENTS = float(1 << 53)


def sum_cents(value: Column) -> Column:
    """Exact sum, in hundredths, of doubles that hold two decimals, as decimal(38,0).

    Finer amounts are rounded to the cent before they are added. Amounts beyond 9e13,
    which doubles do not hold to the cent, are added as they are; a total beyond 1e36
    is null, so that no single amount ends a run.
    """
    whole = F.rint(value * 100)
    ordinary = F.when(F.abs(whole) < EXACT_CENTS, whole)
    high = F.floor(ordinary / F.lit(float(HALF))).cast("bigint")
    exact = _halves(high, (ordinary - high.cast("double") * F.lit(float(HALF))).cast("bigint")).cast("decimal(38,0)")
    rough = F.sum(F.when(F.abs(whole) >= EXACT_CENTS, whole))
    return F.when(rough.isNull(), exact).otherwise(
        F.try_add(F.coalesce(exact, F.lit(0).cast("decimal(38,0)")), rough.try_cast("decimal(38,0)"))
    )


def sum_money(value: Column) -> Column:
    """Exact sum of doubles that hold two decimals."""
    return from_cents(sum_cents(value))


def ratio_with_floor(numerator: Column, denominator: Column, floor: float) -> Column:
    """``numerator / max(denominator, floor)``."""
    return numerator / F.greatest(denominator, F.lit(floor))


def population_stddev(n: Column, total: Column, squares: Column) -> Column:
    """Population standard deviation from count, sum and sum of squares of integers.

    The difference of the two products is taken in exact decimals, so nothing
    cancels and the result does not depend on merge order.
    """
    whole = "decimal(38,0)"
    left = F.try_multiply(n.cast("decimal(19,0)"), squares.cast(whole))
    right = F.try_multiply(total.cast("decimal(19,0)"), total.cast("decimal(19,0)"))
    exact = F.sqrt(F.try_subtract(left, right).cast("double")) / n
    # Beyond 38 digits, where doubles differ by more than the products' last digits.
    mean = total.cast("double") / n
    rough = F.sqrt(F.greatest(squares.cast("double") / n - mean * mean, F.lit(0.0)))
    return F.coalesce(exact, rough)

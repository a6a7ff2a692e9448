import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from salesmart.functions import numeric
from salesmart.functions.dates import date_key, is_weekend, parse_date


@pytest.mark.parametrize(
    "value, expected",
    [(1.005, 1.01), (2.675, 2.68), (0.285, 0.29), (257.35, 257.35), (48.3 / 28.0, 1.73), (-1.005, -1.01)],
)
def test_round_half_up(spark, value, expected):
    df = spark.range(1).select(numeric.round_half_up(F.lit(value), 2).alias("r"))
    assert df.first().r == expected


def test_round_half_up_leaves_huge_values_alone(spark):
    df = spark.range(1).select(numeric.round_half_up(F.lit(1e35), 2).alias("r"))
    assert df.first().r == 1e35


@pytest.mark.parametrize("value", [9e28, -9e28, 1.1e29, 1e300])
def test_round_half_up_at_its_border(spark, value):
    """Whole numbers as they are, on both sides of what the decimal holds."""
    assert spark.range(1).select(numeric.round_half_up(F.lit(value), 2).alias("r")).first().r == value


def test_money_at_the_border_of_exact_cents(spark):
    """Up to 2**53 cents exact, beyond as doubles; a total that no decimal holds is null."""
    exact = float((1 << 53) - 1) / 100
    total = lambda *x: spark.createDataFrame([(v,) for v in x], "x double").agg(numeric.sum_money(F.col("x")).alias("s")).first().s
    assert total(exact, -exact, 0.01) == 0.01
    assert total(1e20, 0.25) == pytest.approx(1e20) and total(1e30, 1e30) == pytest.approx(2e30)
    assert total(1e36, 1e36) is None and total(1e300) is None
    assert total(None) is None and total(None, 1.5) == 1.5


@pytest.mark.parametrize("value, expected", [(2.5, 2), (3.5, 4), (-2.5, -2), (10.500000000000002, 11)])
def test_round_half_even(spark, value, expected):
    assert spark.range(1).select(numeric.round_half_even(F.lit(value)).alias("r")).first().r == expected


@settings(max_examples=10, deadline=None)
@given(amounts=st.lists(st.integers(-10**9, 10**9), min_size=1, max_size=40))
def test_money_adds_up_exactly_in_any_order(spark, amounts):
    rows = [(a / 100,) for a in amounts]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "x double").repartition(3)
        assert df.agg(numeric.sum_money(F.col("x")).alias("s")).first().s == sum(amounts) / 100


def test_money_beyond_bigint_cents_adds_up(spark):
    df = spark.createDataFrame([(9e16,), (9e16,), (2e17,), (-1e20,)], "x double")
    assert df.agg(numeric.sum_money(F.col("x")).alias("s")).first().s == pytest.approx(3.8e17 - 1e20)


def test_deviation_of_large_quantities(spark):
    df = spark.createDataFrame([(2_100_000_000,), (2_100_000_000,), (2_000_000_000,), (2_000_000_000,)], "q bigint")
    q = F.col("q")
    sums = df.agg(F.count("q").alias("n"), F.sum("q").alias("s"), numeric.sum_whole(q * q).alias("ss"))
    got = sums.select(numeric.population_stddev(F.col("n"), F.col("s"), F.col("ss")).alias("d")).first().d
    assert got == pytest.approx(5e7)


@settings(max_examples=10, deadline=None)
@given(values=st.lists(st.integers(0, 10**6), min_size=1, max_size=40))
def test_population_stddev(spark, values):
    import statistics

    df = spark.createDataFrame([(v,) for v in values], "q int")
    q = F.col("q").cast("bigint")
    got = (
        df.agg(F.count("q").alias("n"), F.sum("q").alias("s"), F.sum(q * q).alias("ss"))
        .select(numeric.population_stddev(F.col("n"), F.col("s"), F.col("ss")).alias("d"))
        .first()
        .d
    )
    assert got == pytest.approx(statistics.pstdev(values), abs=1e-9)


def test_dates(spark):
    df = spark.createDataFrame(
        [("2026-06-06",), ("2026-06-07",), ("2026-06-08",), ("nope",), (None,)], "d string"
    ).select(parse_date(F.col("d")).alias("d"))
    rows = df.select(date_key(F.col("d")).alias("k"), is_weekend(F.col("d")).alias("w")).collect()
    assert [r.k for r in rows] == [20260606, 20260607, 20260608, None, None]
    assert [r.w for r in rows[:3]] == [1, 1, 0]

import pytest
from pyspark.sql import functions as F

from salesmart.operators import summaries


def _bands(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    return [r.stock_risk for r in summaries.stock_risk_bands(df, "x").orderBy("x").collect()]


def test_bands_low_cut_wins(spark):
    values = [4.95, 4.97, 5.01, 5.05, 5.05, 5.08, 5.08, 5.19, 5.25, 5.27]
    assert _bands(spark, values) == ["understock"] * 5 + ["overstock"] * 5


def test_equal_values_are_all_understock(spark):
    assert _bands(spark, [3, 3, 3]) == ["understock"] * 3


def test_ties_rank_by_id(fact_of):
    fact = fact_of({"product_id": 7}, {"product_id": 3}, {"product_id": 5, "price": 99.0})
    top = summaries.top_products(fact).orderBy("rank").collect()
    assert [(r.rank, r.product_id) for r in top] == [(1, 5), (2, 3), (3, 7)]
    assert top[-1].cumulative_share_pct == 100.0


def test_top_n_shares_are_of_all_revenue(fact_of):
    fact = fact_of(*({"product_id": i} for i in range(1, 5)))
    top = summaries.top_products(fact, n=2).orderBy("rank").collect()
    assert [(r.revenue_share_pct, r.cumulative_share_pct) for r in top] == [(25.0, 25.0), (25.0, 50.0)]


def test_zero_revenue_has_zero_shares(fact_of):
    fact = fact_of({"price": 0.0}, {"product_id": 2, "price": 0.0})
    assert {r.revenue_share_pct for r in summaries.top_products(fact).collect()} == {0.0}


def test_product_features(fact_of):
    fact = fact_of(
        {"sales_quantity": 1.0},
        {"sales_quantity": 3.0, "stock_quantity": 20.0},
        {"sales_quantity": 5.0, "date": "2026-06-07", "store_id": 2},
    )
    row = summaries.product_features(fact).first()
    assert (row.total_sales, row.avg_daily_sales, row.store_count) == (9, 4.5, 2)
    assert (row.sales_volatility, row.avg_stock, row.revenue) == (1.63, 40.0, 90.0)
    assert row.stock_to_sales_ratio == 8.89


def test_distinct_counts_can_be_approximate(fact_of):
    fact = fact_of(*({"product_id": i, "store_id": i % 4} for i in range(12)))
    exact = summaries.kpi_snapshot(fact).first()
    rough = summaries.kpi_snapshot(fact, distinct=F.approx_count_distinct).first()
    assert (exact.products, exact.stores) == (12, 4) == (rough.products, rough.stores)


def test_totals_agree_across_summaries(fact_of):
    fact = fact_of(
        *(
            {"product_id": i % 7, "store_id": i % 5, "warehouse_id": i % 5 % 2, "date": f"2026-0{1 + i % 3}-0{1 + i % 9}", "sales_quantity": float(i)}
            for i in range(60)
        )
    )
    kpi = summaries.kpi_snapshot(fact).first()
    for name in ("warehouse_summary", "store_summary", "time_summary"):
        total = getattr(summaries, name)(fact).groupBy().sum("units_sold", "txn_count").first()
        assert tuple(total) == (kpi.total_units, kpi.transactions)
    reduced = summaries.units_by_warehouse(fact).groupBy().sum("units_sold_mr").first()[0]
    assert reduced == kpi.total_units


def test_reduce_by_key_agrees(fact_of):
    fact = fact_of(*({"product_id": i, "warehouse_id": i % 3, "sales_quantity": float(i)} for i in range(20)))
    pairs = fact.select("warehouse_id", "sales_quantity").rdd.map(tuple)
    expected = dict(pairs.reduceByKey(lambda a, b: a + b).collect())
    assert dict(map(tuple, summaries.units_by_warehouse(fact).collect())) == expected


def test_extreme_rows_do_not_abort_the_summaries(fact_of):
    fact = fact_of(*(dict(sales_quantity=2.1e9, store_id=i, price=1e8 * i) for i in range(1, 5)))
    assert summaries.product_features(fact).first().total_sales == 8_400_000_000
    assert summaries.warehouse_summary(fact).count() == 1
    assert summaries.kpi_snapshot(fact).first().total_revenue == pytest.approx(2.1e18)

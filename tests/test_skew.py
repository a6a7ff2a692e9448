"""One key holding a third of all rows, against brute force in pandas."""

import numpy as np
import pandas as pd
import pytest

from salesmart.operators import star, summaries
from salesmart.operators.enrich import enrich_sales
from salesmart.operators.quality import clean_sales
from salesmart.plans import sqlsuite

ROWS = 3000


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(11)
    hot = rng.random(ROWS) < 1 / 3
    product = np.where(hot, 1, rng.integers(2, 200, ROWS))
    store = np.where(hot, 7, rng.integers(1, 40, ROWS))
    days = pd.Timestamp("2026-06-01") + pd.to_timedelta(rng.integers(0, 60, ROWS), unit="D")
    frame = pd.DataFrame(
        {
            "date": days.strftime("%Y-%m-%d"),
            "product_id": product,
            "product_name": [f"name {p % 50}" for p in product],
            "store_id": store,
            "warehouse_id": store % 5,
            "sales_quantity": rng.integers(0, 30, ROWS).astype(float),
            "stock_quantity": rng.integers(20, 500, ROWS).astype(float),
            "price": product + 0.25,
            "revenue": np.arange(ROWS, dtype=float),
        }
    )
    fact = enrich_sales(clean_sales(spark.createDataFrame(frame).repartition(6))).cache()
    return fact, frame.assign(money=frame.sales_quantity * frame.price)


def test_features_of_a_hot_product(skewed):
    fact, frame = skewed
    got = {r.product_id: r for r in summaries.product_features(fact).collect()}
    for product, rows in frame.groupby("product_id"):
        row = got[product]
        assert row.total_sales == rows.sales_quantity.sum()
        assert row.revenue == pytest.approx(rows.money.sum())
        assert row.store_count == rows.store_id.nunique()
        assert row.avg_daily_sales == pytest.approx(rows.sales_quantity.sum() / rows.date.nunique(), abs=0.0051)
        assert row.sales_volatility == pytest.approx(rows.sales_quantity.std(ddof=0), abs=0.0051)


def test_joined_sums_of_hot_keys(spark, skewed):
    fact, frame = skewed
    sqlsuite.register_views(star.build_star(fact))
    stores = {r.store_id: r.units for r in sqlsuite.run_named(spark, "q7_store_in_warehouse").collect()}
    assert stores == frame.groupby("store_id").sales_quantity.sum().astype(int).to_dict()
    names = sqlsuite.run_named(spark, "q2_top_products_by_name").collect()
    top = frame.groupby("product_name").money.sum().sort_values(ascending=False).head(10)
    assert [r.revenue for r in names] == pytest.approx(list(top))


def test_orphans_of_a_hot_key(skewed):
    fact, frame = skewed
    tables = star.build_star(fact)
    tables["dim_product"] = tables["dim_product"].filter("product_id <> 1")
    orphans = star.star_integrity(tables).filter("check_type = 'foreign_key' AND violations > 0")
    assert [tuple(r) for r in orphans.collect()] == [
        ("fact_sales", "foreign_key", "product_id", int((frame.product_id == 1).sum()))
    ]

import pytest

from salesmart.operators import dashboard, scenarios


@pytest.fixture
def baseline(spark):
    return spark.createDataFrame(
        [(509720, 15476369, 9, "star_schema")],
        "baseline_units bigint, baseline_stock bigint, high_demand_products bigint, baseline_from string",
    )


def test_forecast_of_published_baseline(baseline):
    rows = scenarios.scenario_forecast(baseline).collect()
    assert {r.scenario: r.expected_units for r in rows} == {
        "Normal": 535206,
        "Festival": 713608,
        "Low demand": 407776,
        "Supply disruption": 433262,
    }
    assert {r.scenario for r in rows if r.risk == "medium"} == {"Festival", "Supply disruption"}


def test_one_scenario_and_unknown_name(baseline):
    assert [r.scenario for r in scenarios.scenario_forecast(baseline, "Festival").collect()] == ["Festival"]
    with pytest.raises(ValueError, match="unknown scenario"):
        scenarios.scenario_forecast(baseline, "Boom")


def test_delta_text(spark, baseline):
    texts = {r.scenario: r.delta_text for r in scenarios.scenario_delta(scenarios.scenario_forecast(baseline)).collect()}
    assert texts == {"Normal": "+5.0%", "Festival": "+40.0%", "Low demand": "-20.0%", "Supply disruption": "-15.0%"}
    empty = spark.createDataFrame([(0, 0)], "baseline_units bigint, expected_units bigint")
    assert scenarios.scenario_delta(empty).first().delta_text is None


def test_baseline_falls_back_to_kpis(spark):
    clusters = spark.createDataFrame([(1, "High")], "product_id int, demand_level string")
    sales = spark.createDataFrame([(1, 5, 7), (2, None, 1)], "product_id int, sales_qty int, stock_qty int")
    kpis = spark.createDataFrame([(40,)], "total_units bigint")
    chosen = lambda s, k: tuple(scenarios.available_baseline(s, clusters, k).first())
    assert chosen(sales, kpis) == (5, 8, 1, "star_schema")
    for none in (sales.where("sales_qty is null"), sales.limit(0), None):
        assert chosen(none, kpis) == (40, 0, 0, "spark_kpis")
    with pytest.raises(ValueError, match="no baseline"):
        scenarios.available_baseline(sales.limit(0), clusters, None)


def test_baseline_without_sales(spark):
    sales = spark.createDataFrame([], "product_id int, sales_qty int, stock_qty int")
    clusters = spark.createDataFrame([(1, "High")], "product_id int, demand_level string")
    row = scenarios.scenario_baseline(sales, clusters).first()
    assert tuple(row) == (0, 0, 1, "star_schema")


def _status(spark):
    rows = [(24, "High", 2.46, 4.8), (7, "Low", 0.0, 1234.4), (8, "Medium", 3.0, 5.88)]
    df = spark.createDataFrame(rows, "product_id int, demand_level string, avg_daily_sales double, avg_stock double")
    return dashboard.inventory_status(df)


def test_inventory_status(spark):
    rows = {r.product_id: (r.stock_ratio, r.status) for r in _status(spark).collect()}
    # 1.96 is rounded to one decimal before it is compared.
    assert rows == {24: (2.0, "Healthy"), 7: (12344.0, "Healthy"), 8: (2.0, "Healthy")}


@pytest.mark.parametrize(
    "query, ids",
    [("", {7, 8, 24}), ("  HIGH ", {24}), ("#7", {7}), ("1,234", {7}), ("2.5", {24}), ("—", {7}), ("zzz", set())],
)
def test_inventory_search(spark, query, ids):
    found = dashboard.inventory_search(_status(spark), query).collect()
    assert {r.product_id for r in found} == ids


def test_tier_share_shows_absent_tiers(spark):
    df = spark.createDataFrame([("Low",), ("Low",), ("High",)], "demand_level string")
    rows = {r.demand_level: (r.products, r.share_pct) for r in dashboard.tier_share(df).collect()}
    assert rows == {"Low": (2, 67), "Medium": (0, 0), "High": (1, 33)}
    empty = dashboard.tier_share(df.limit(0)).collect()
    assert {r.share_pct for r in empty} == {0}


def test_warehouse_figures(spark):
    df = spark.createDataFrame(
        [(3, 9000, 50.0, 10.5), (1, 9000, 61.0, 20.25), (2, 100, 0.5, 1.0)],
        "warehouse_id int, units_sold bigint, avg_stock double, revenue double",
    )
    assert tuple(dashboard.warehouse_mini_stats(df).first()) == (1, 9000, 37, 31.75)
    risk = {r.warehouse_id: r.velocity_risk for r in dashboard.warehouse_velocity_risk(df).collect()}
    assert risk == {3: "Balanced", 1: "Balanced", 2: "Balanced"}
    tight = dashboard.warehouse_velocity_risk(df, under=5.6, over=6.0)
    assert {r.warehouse_id: r.velocity_risk for r in tight.collect()} == {3: "Understock", 1: "Overstock", 2: "Understock"}

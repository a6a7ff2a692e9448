import pytest

from salesmart.operators import star, summaries
from salesmart.plans import batch, sqlsuite
from salesmart.plans.testtables import fixed_tiers, raw_sales
from salesmart.schema import RAW_CSV_SCHEMA
from salesmart.sources.tables import write_table

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("run"))
    raw = raw_sales(spark, SF_DIR).toDF(*RAW_CSV_SCHEMA.fieldNames())
    write_table(raw, f"{folder}/raw", "csv")
    return batch.run_pipeline(spark, f"{folder}/raw", f"{folder}/out"), folder


def test_counts(run):
    result, _ = run
    assert (result.raw_rows, result.clean_rows) == (6017, 5972)
    assert result.kpis["total_units"] == 151663
    assert result.kpis["total_revenue"] == 137977714.80


def test_disjoint_dirt_adds_up(run):
    before, after = sorted(run[0].outputs["dq_stages"].collect(), key=lambda r: r.stage, reverse=True)
    removed = before.null_any_key_field + before.negative_stock + before.duplicate_rows
    assert after.total_rows == before.total_rows - removed == 5972
    assert after.duplicate_rows == 0


def test_written_summaries_agree(run):
    result, _ = run
    units = result.kpis["total_units"]
    for name in ("warehouse_summary", "store_summary", "time_summary"):
        assert result.outputs[name].groupBy().sum("units_sold").first()[0] == units
    assert result.outputs["units_by_warehouse"].groupBy().sum("units_sold_mr").first()[0] == units


def test_csv_outputs(spark, raw_of, tmp_path):
    raw = raw_of({}, {"product_id": 2, "sales_quantity": 5.0}, {"stock_quantity": -5.0})
    result = batch.run_pipeline(spark, raw, str(tmp_path), file_format="csv")
    header = spark.read.text(f"{tmp_path}/store_summary/*.csv").first().value
    assert header == "store_id,warehouse_id,units_sold,revenue,avg_stock,txn_count"
    assert result.outputs["store_summary"].first().units_sold == 7


def test_missing_input_fails(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        batch.run_pipeline(spark, str(tmp_path / "absent"), str(tmp_path / "out"))


def test_suite_reports_failures_and_goes_on(spark, run, tmp_path):
    fact = run[0].outputs["clean_sales"]
    clusters = fixed_tiers(summaries.product_features(fact))
    sqlsuite.register_views(star.build_star(fact) | {"product_clusters": clusters})
    queries = {"broken": "SELECT nope FROM fact_sales", "q1_warehouse_units": sqlsuite.QUERIES["q1_warehouse_units"]}
    rows = {r.query: r for r in sqlsuite.run_query_suite(spark, str(tmp_path), queries).collect()}
    assert rows["broken"].status == "failed" and "UNRESOLVED" in rows["broken"].error
    assert (rows["q1_warehouse_units"].status, rows["q1_warehouse_units"].row_count) == ("ok", 10)


def test_any_sql_runs_on_the_views(spark, run):
    """SQL written by hand: USING, ordinal and alias grouping, ordering by an alias."""
    fact = run[0].outputs["clean_sales"]
    sqlsuite.register_views(star.build_star(fact))
    by_day = spark.sql(
        "SELECT weekday AS d, COUNT(*) AS lines, ROUND(SUM(revenue), 1) AS takings"
        " FROM dim_date JOIN fact_sales USING (date_id) GROUP BY 1 ORDER BY takings DESC"
    ).collect()
    assert sum(r.lines for r in by_day) == 5972
    assert [r.takings for r in by_day] == sorted((r.takings for r in by_day), reverse=True)
    halves = spark.sql("SELECT month > 6 AS late, COUNT(*) AS n FROM dim_date GROUP BY late")
    assert halves.count() == 2
    split = {r.day_type: r.units for r in spark.sql(sqlsuite.QUERIES["q6_weekend_split"]).collect()}
    assert split["weekend"] + split["weekday"] == 151663


def test_store_units_add_up_to_their_warehouse(spark, run):
    fact = run[0].outputs["clean_sales"]
    sqlsuite.register_views(star.build_star(fact))
    per_store = spark.sql(sqlsuite.QUERIES["q7_store_in_warehouse"]).groupBy("warehouse_id").sum("units")
    per_warehouse = spark.sql(sqlsuite.QUERIES["q1_warehouse_units"])
    assert dict(map(tuple, per_store.collect())) == {r.warehouse_id: r.units for r in per_warehouse.collect()}


def test_run_full(spark, run):
    _, folder = run
    tables = batch.run_full(spark, f"{folder}/raw", f"{folder}/full", seeds=range(2))
    assert tables["fact_sales"].count() == 5972
    tiers = {r.demand_level: r.avg for r in tables["product_clusters"].groupBy("demand_level").agg({"avg_daily_sales": "avg"}).withColumnRenamed("avg(avg_daily_sales)", "avg").collect()}
    assert tiers["Low"] < tiers["Medium"] < tiers["High"]
    assert tables["product_clusters"].count() == tables["product_features"].count()
    forecast = {r.scenario: r for r in tables["scenario_forecast"].collect()}
    assert forecast["Festival"].expected_units == round(151663 * 1.4)
    assert {r.baseline_from for r in forecast.values()} == {"star_schema"}
    assert all(r.explanation.startswith("Rule-based") for r in forecast.values())


def test_reports_from_summaries_equal_those_from_the_fact(run):
    outputs = run[0].outputs
    fact = outputs["clean_sales"]
    for name, plain in {
        "units_by_warehouse": summaries.units_by_warehouse,
        "top_products": summaries.top_products,
        "kpis": summaries.kpi_snapshot,
    }.items():
        want = plain(fact)
        assert sorted(map(str, outputs[name].select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert set(outputs["kpis"].columns) == set(summaries.kpi_snapshot(fact).columns)


def test_extreme_sales_do_not_end_the_run(spark, raw_of, tmp_path):
    raw = raw_of(
        *({"store_id": s, "sales_quantity": 2.1e9, "price": 1.0} for s in range(1, 5)),
        {"product_id": 2, "sales_quantity": 2.0, "price": 1e17},
    )
    result = batch.run_pipeline(spark, raw, str(tmp_path))
    assert result.kpis["total_units"] == 4 * 2_100_000_000 + 2
    assert result.kpis["total_revenue"] == pytest.approx(2e17, rel=1e-6)
    volatility = {r.product_id: r.sales_volatility for r in result.outputs["product_features"].collect()}
    assert set(volatility.values()) == {0.0}


def test_run_full_writes_the_suite(spark, run):
    _, folder = run
    tables = batch.run_full(spark, f"{folder}/raw", f"{folder}/suite", seeds=range(1))
    suite = {r.query: r for r in tables["query_suite"].collect()}
    assert set(suite) == set(sqlsuite.QUERIES) and {r.status for r in suite.values()} == {"ok"}
    for name, row in suite.items():
        assert spark.read.parquet(f"{folder}/suite/queries/{name}").count() == row.row_count


def test_corrupt_lines_are_counted(spark, tmp_path):
    header = ",".join(RAW_CSV_SCHEMA.fieldNames())
    good = "2026-06-06,1,Product_1,2,3,4.0,50,9.99,39.96"
    lines = [header, good, good, good.replace("9.99", "cheap"), good + ",more", good.replace(",1,", ",2,")]
    (tmp_path / "raw.csv").write_text("\n".join(lines) + "\n")
    result = batch.run_pipeline(spark, str(tmp_path / "raw.csv"), str(tmp_path / "out"))
    assert (result.raw_rows, result.corrupt_rows, result.clean_rows) == (5, 2, 2)


def test_an_empty_run(spark, raw_of, tmp_path):
    result = batch.run_pipeline(spark, raw_of({"price": None}), str(tmp_path))
    assert (result.raw_rows, result.clean_rows, result.corrupt_rows) == (1, 0, 0)
    assert result.kpis["date_min"] is None and result.kpis["total_units"] == 0


@pytest.mark.parametrize("price, total", [(1e30, 1e30), (1e300, None)])
def test_one_absurd_amount_does_not_end_the_run(spark, raw_of, tmp_path, price, total):
    """A sum beyond what a decimal holds is null; everything else is as without that sale."""
    raw = raw_of({"store_id": 1}, {"product_id": 2, "sales_quantity": 1.0, "price": price}, {"store_id": 3, "price": 9e13})
    tables = batch.run_full(spark, raw, str(tmp_path), seeds=range(1), k=2)
    stores = {r.store_id: r.revenue for r in tables["store_summary"].collect()}
    assert stores[3] == pytest.approx(18e13) and (stores[1] is None if total is None else stores[1] == pytest.approx(total))
    snapshot = summaries.kpi_snapshot(tables["clean_sales"]).first()
    assert snapshot.transactions == 3 and snapshot.stores == 2
    for found in (snapshot, tables["kpis"].first()):
        assert found.total_units == 5
    assert snapshot.total_revenue is None if total is None else snapshot.total_revenue == pytest.approx(total)
    assert {r.status for r in tables["query_suite"].collect()} == {"ok"}

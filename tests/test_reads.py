"""How often queries read and shuffle their input, on the plans that ran."""

import pytest
from plans import final_plan, scans
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from salesmart.operators import quality, star, summaries
from salesmart.plans import batch, registry
from salesmart.plans.testtables import raw_sales

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["warehouse_summary", "stock_risk_bands", "top_products", "kpi_snapshot", "dq_report", "dq_profile"])
def test_one_scan_of_the_lines(spark, name):
    plan = final_plan(entry_module.queries()[name](spark, SF_DIR))
    assert scans(plan, "l_partkey") == 1
    if name in ("warehouse_summary", "stock_risk_bands", "top_products"):
        assert "ReusedExchange" in plan
    if name == "kpi_snapshot":
        assert "Expand" not in plan


@pytest.mark.parametrize(
    "name", ["q2_top_products_by_name", "q3_monthly_trend", "q6_weekend_split", "q7_store_in_warehouse", "api_sales_summary", "monthly_chart_series"]
)
def test_views_of_a_suite_query_share_one_fact(spark, name, monkeypatch):
    """The fact is written from one scan of the lines; the query itself reads no line."""
    seen = []
    write = registry.write_table
    monkeypatch.setattr(registry, "write_table", lambda df, path: seen.append(final_plan(df)) or write(df, path))
    result = entry_module.queries()[name](spark, SF_DIR)
    assert scans(final_plan(result), "l_partkey") == 0
    assert [scans(p, "l_partkey") for p in seen] == [1]


def test_quality_report_moves_short_rows(spark):
    """No column of the raw rows is in an exchange, only fingerprints, marks and counts."""
    plan = final_plan(quality.dq_report(raw_sales(spark, SF_DIR, dirty=True)))
    exchanges = [line for line in plan.splitlines() if " Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and all("_one" in e for e in exchanges)
    assert not any(c in e for e in exchanges for c in ("product_name", "price", "date"))


def test_integrity_moves_words_of_ids(spark, tmp_path):
    """One row for 64 neighbouring sale ids is shuffled, not one a sale."""
    sales = star.fact_sales(registry._fact(spark, SF_DIR), with_sale_id=True)
    sales.coalesce(1).write.parquet(str(tmp_path / "sales"))
    sales = spark.read.parquet(str(tmp_path / "sales"))
    checks = star._column_checks(sales, "fact_sales", "sale_id", star.NOT_NULL["fact_sales"])
    plan = final_plan(checks)
    assert scans(plan, "sale_id") == 1 and "partial_bit_or" in plan
    assert not any("Exchange" in line and "sale_id" in line for line in plan.splitlines())
    words = sales.select(F.shiftright("sale_id", 6).alias("w")).distinct().count()
    assert words <= sales.count() / 64 + sales.select(F.shiftright("sale_id", 33)).distinct().count()


def test_run_reads_the_fact_five_times(spark, tmp_path, monkeypatch):
    plans = []
    write = batch.write_table

    def watched(df, path, *more, **options):
        if not path.endswith("/clean_sales"):
            plans.append(final_plan(df))
        return write(df, path, *more, **options)

    monkeypatch.setattr(batch, "write_table", watched)
    batch.run_pipeline(spark, raw_sales(spark, SF_DIR), str(tmp_path))
    assert len(plans) == 8
    assert sum(scans(p, "clean_sales") for p in plans) <= 5


def test_distinct_ids_of_all_kinds(spark):
    """Bitmaps against plain distinct counts: negative, huge, null and scattered ids."""
    rows = [(i % 7 - 3, i * 977 % 131, (1 << 62) + i % 3 if i % 5 else None, i, 1.0, "2026-06-06") for i in range(900)]
    rows += [(None, None, None, 1, 0.5, None)]
    fact = spark.createDataFrame(rows, "product_id bigint, store_id int, warehouse_id bigint, sales_quantity int, revenue double, date string")
    fact = fact.withColumn("date", F.col("date").cast("date")).repartition(5)
    assert summaries.kpi_snapshot(fact).collect() == summaries.kpi_snapshot(fact, F.count_distinct).collect()
    assert summaries.kpi_snapshot(fact.limit(0)).collect() == summaries.kpi_snapshot(fact.limit(0), F.count_distinct).collect()


def test_every_counter_of_the_dirty_rows_counts(spark):
    profile = entry_module.queries()["dirty_dq_profile"](spark, SF_DIR).first().asDict()
    assert all(profile[c] > 0 for c in quality.COUNTERS)
    report = entry_module.queries()["dirty_dq_report"](spark, SF_DIR).where("stage = 'after_clean'").first()
    assert report.duplicate_rows > 0 and report.null_any_key_field == 0


@pytest.mark.parametrize("by_product", [True, False])
def test_features_move_a_row_per_product(spark, by_product):
    """No row is expanded for the distinct days and stores; sales that lie by product are not shuffled again."""
    rows = [(i % 7, f"p{i % 2}", 1 + i % 3, 5, 1.0, 1.0, f"2026-06-{1 + i % 9:02d}", i % 5) for i in range(300)]
    names = "product_id int, product_name string, sales_quantity int, stock_quantity int, revenue double, price double, date string, store_id int"
    sales = spark.createDataFrame(rows, names).withColumn("date", F.col("date").cast("date"))
    features = summaries.product_features(sales.repartition(4, *(["product_id"] if by_product else [])))
    plan = final_plan(features)
    assert "Expand" not in plan
    assert plan.count(" Exchange ") == (1 if by_product else 2)
    plain = sales.groupBy("product_id", "product_name").agg(F.count_distinct("store_id"), F.sum("sales_quantity"), F.count_distinct("date"))
    want = {tuple(r)[:4] + (round(r[3] / r[4] + 1e-9, 2),) for r in plain.collect()}
    assert {(r.product_id, r.product_name, r.store_count, r.total_sales, r.avg_daily_sales) for r in features.collect()} == want

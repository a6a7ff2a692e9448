import pytest

from salesmart.operators import quality
from salesmart.operators.enrich import enrich_sales
from salesmart.operators.summaries import kpi_snapshot

NAN, INF = float("nan"), float("inf")


def test_missing_values_are_dropped_and_counted(raw_of):
    raw = raw_of(
        {"sales_quantity": None},
        {"sales_quantity": NAN},
        {"stock_quantity": None},
        {"product_name": None},
        {"price": INF},
    )
    profile = quality.profile_dq(raw).first()
    assert (profile.null_any_key_field, profile.null_sales_quantity, profile.null_stock_quantity) == (4, 2, 1)
    assert [r.product_name for r in quality.clean_sales(raw).collect()] == [None]


def test_counters_overlap(raw_of):
    dirty = {"sales_quantity": None, "stock_quantity": -5.0}
    raw = raw_of(dirty, dirty, {"sales_quantity": -1.0}, {})
    p = quality.profile_dq(raw).first().asDict()
    assert p == {
        "stage": "before_clean",
        "total_rows": 4,
        "null_any_key_field": 2,
        "null_sales_quantity": 2,
        "null_stock_quantity": 0,
        "negative_sales": 1,
        "negative_stock": 2,
        "duplicate_rows": 1,
    }
    report = {r.stage: r for r in quality.dq_report(raw).collect()}
    assert report["after_clean"].total_rows == 1
    assert (report["after_clean"].rows_removed, report["after_clean"].pct_removed) == (3, 75.0)
    assert report["before_clean"].rows_removed is None


def test_only_full_copies_collapse(raw_of):
    raw = raw_of({}, {}, {"revenue": 1.0}, {"revenue": 2.0})
    assert quality.clean_sales(raw).count() == 3
    # What is left equal after cleaning shows up in the after row.
    after = quality.dq_report(raw).filter("stage = 'after_clean'").first()
    assert (after.total_rows, after.duplicate_rows) == (3, 2)


def test_hot_row_collapses(spark, raw_of):
    hot = raw_of({}).crossJoin(spark.range(5000)).drop("id")
    raw = hot.unionByName(raw_of(*({"product_id": i} for i in range(2, 50))))
    profile = quality.profile_dq(raw).first()
    assert (profile.total_rows, profile.duplicate_rows) == (5048, 4999)
    assert quality.clean_sales(raw).count() == 49


def test_bad_dates_are_dropped_without_error(raw_of):
    raw = raw_of(
        {"date": "2026-06-06"},
        {"date": "2026-06-07"},
        {"date": "2026-06-08"},
        {"date": "nope"},
        {"date": None},
    )
    clean = quality.clean_sales(raw)
    assert clean.count() == 4
    fact = enrich_sales(clean).orderBy("date").collect()
    assert [r.is_weekend for r in fact] == [1, 1, 0]
    assert [r.day_of_week for r in fact] == [7, 1, 2]
    assert [r.week for r in fact] == [23, 23, 24]
    assert quality.dq_report(raw).filter("stage = 'after_clean'").first().rows_removed == 2


def test_quantities_truncate_and_reject(raw_of):
    raw = raw_of(*({"sales_quantity": q} for q in (7.9, -0.5, 0.0, 1e12)))
    assert sorted(r.sales_quantity for r in quality.clean_sales(raw).collect()) == [0, 7]
    assert quality.dq_report(raw).filter("stage = 'after_clean'").first().rows_removed == 2


def test_revenue_uses_truncated_quantity(raw_of):
    fact = enrich_sales(quality.clean_sales(raw_of({"sales_quantity": 3.9, "price": 0.335, "revenue": 9.0})))
    assert fact.first().revenue == 1.01


def test_observed_counters_equal_profile(spark, raw_of, tmp_path):
    raw = raw_of({}, {}, {"sales_quantity": None}, {"stock_quantity": -5.0}, {"date": "nope"})
    clean, observation = quality.clean_and_observe(raw)
    clean.write.parquet(str(tmp_path / "clean"))
    profile = quality.profile_dq(raw).drop("stage").first().asDict()
    assert observation.get == profile
    written = spark.read.parquet(str(tmp_path / "clean"))
    assert sorted(map(str, written.collect())) == sorted(map(str, quality.clean_sales(raw).collect()))


def test_empty_input(raw_of):
    raw = raw_of({}).limit(0)
    report = quality.dq_report(raw).collect()
    assert [(r.stage, r.total_rows) for r in report] == [("before_clean", 0), ("after_clean", 0)]
    assert (report[1].rows_removed, report[1].pct_removed) == (0, 0.0)
    kpis = kpi_snapshot(enrich_sales(quality.clean_sales(raw))).first()
    assert (kpis.transactions, kpis.total_units, kpis.total_revenue) == (0, 0, 0.0)
    assert kpis.date_min is None and kpis.date_max is None


def test_require_columns(raw_of):
    raw = raw_of({})
    assert quality.require_columns(raw, ["price"]) is raw
    with pytest.raises(ValueError, match="avg_stock"):
        quality.require_columns(raw, ["price", "avg_stock"])


def test_fill_missing_features(spark):
    df = spark.createDataFrame([(1, None), (2, NAN), (3, 4.5)], "id int, x double")
    assert [r.x for r in quality.fill_missing_features(df, ["x"]).orderBy("id").collect()] == [0.0, 0.0, 4.5]

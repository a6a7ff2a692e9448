"""Named queries over the given tables; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.functions.numeric import round_half_up
from salesmart.operators import dashboard, quality, scenarios, star, summaries, tiers
from salesmart.operators.enrich import date_attributes, enrich_sales, snake_case_columns
from salesmart.plans import batch, sqlsuite
from salesmart.plans.testtables import fixed_tiers, raw_sales
from salesmart.schema import FACT_SCHEMA, RAW_CSV_SCHEMA, SALE_COLUMNS, TIER_FEATURES
from salesmart.sources.readers import load_processed, read_sales
from salesmart.sources.tables import (
    append_table,
    replace_table,
    scratch_dir,
    write_report_json,
    write_table,
)

Query = Callable[[SparkSession, str], DataFrame]


def _fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_sales(quality.clean_sales(raw_sales(spark, sf_dir)))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.product_features(_fact(spark, sf_dir))


def _tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_tiers(_features(spark, sf_dir))


def _on_dirty(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(raw_sales(spark, sf_dir, dirty=True))


def _on_raw(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(raw_sales(spark, sf_dir))


def _on_fact(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_fact(spark, sf_dir))


def _on_tiers(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(_tiered(spark, sf_dir))


def _report(name: str) -> Query:
    return _on_fact(lambda f: summaries.in_report_order(getattr(summaries, name)(f), name))


def _star_views(spark: SparkSession, sf_dir: str, name: str) -> None:
    """The views that a query names; a fact that several of them read is written once."""
    text = sqlsuite.QUERIES[name]
    named = [t for t in (*star.TABLES, "product_clusters") if t in text]
    fact = _fact(spark, sf_dir)
    if len(named) > 1:
        path = scratch_dir(spark, name) + "/fact"
        fact = write_table(fact.select(*SALE_COLUMNS, "revenue"), path)
    tables = {t: df for t, df in star.build_star(fact).items() if t in named}
    if "product_clusters" in named:
        tables["product_clusters"] = fixed_tiers(summaries.product_features(fact))
    sqlsuite.register_views(tables)


def _suite_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _star_views(spark, sf_dir, name)
        return sqlsuite.run_named(spark, name)

    return run


# --- sources and sinks -------------------------------------------------------


def ingest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows written as CSV under the published header, then read by the typed reader."""
    raw = raw_sales(spark, sf_dir).toDF(*RAW_CSV_SCHEMA.fieldNames())
    path = scratch_dir(spark, "csv") + "/sales"
    write_table(raw, path, "csv")
    return read_sales(spark, path)


def sink_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = summaries.store_summary(_fact(spark, sf_dir))
    path = scratch_dir(spark, "sink") + "/store_summary"
    return write_table(summaries.in_report_order(report, "store_summary"), path, "csv")


def sink_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON report, read back and flattened to one row per stage, with all it holds."""
    raw = raw_sales(spark, sf_dir)
    fact = enrich_sales(quality.clean_sales(raw))
    path = scratch_dir(spark, "report") + "/dq_report"
    document = write_report_json(quality.dq_report(raw), summaries.kpi_snapshot(fact), path)
    return document.select(F.inline("dq"), "kpis").select("*", "kpis.*").drop("kpis")


def sink_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table filled with other rows, replaced by its own weekdays, appended the weekend by a run that is repeated."""
    path = scratch_dir(spark, "replace") + "/daily"
    fact = _fact(spark, sf_dir)
    daily = fact.groupBy("date", "is_weekend").agg(F.sum("sales_quantity").alias("units"))
    weekend = daily.filter("is_weekend = 1")
    replaced = replace_table(daily, path)
    replace_table(replaced.filter("is_weekend = 0"), path)
    append_table(weekend, path, run_id="weekend")
    return append_table(weekend, path, run_id="weekend")


def processed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact written as CSV and loaded with its schema; the preferred path is absent."""
    folder = scratch_dir(spark, "processed")
    write_table(_fact(spark, sf_dir), f"{folder}/fallback", "csv")
    return load_processed(
        spark, [f"{folder}/preferred", f"{folder}/fallback"], FACT_SCHEMA, "csv"
    )


# --- quality and enrichment --------------------------------------------------


def blanked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with gaps: no volatility for rarely stocked products, NaN stock for cheap ones."""
    features = _features(spark, sf_dir)
    gaps = features.withColumns(
        {
            "sales_volatility": F.when(F.col("store_count") >= 28, F.col("sales_volatility")),
            "avg_stock": F.when(F.col("avg_price") < 920, F.lit(float("nan"))).otherwise(
                F.col("avg_stock")
            ),
        }
    )
    return quality.fill_missing_features(gaps, TIER_FEATURES).select("product_id", *TIER_FEATURES)


def checked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.require_columns(_features(spark, sf_dir), TIER_FEATURES).select(
        "product_id", *TIER_FEATURES
    )


def renamed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = raw_sales(spark, sf_dir).toDF(*RAW_CSV_SCHEMA.fieldNames())
    return snake_case_columns(published)


# --- star, suite, runs -------------------------------------------------------


def _written_fact(spark: SparkSession, sf_dir: str, purpose: str) -> tuple[DataFrame, str]:
    """The fact as a table, for queries with many consumers of it."""
    folder = scratch_dir(spark, purpose)
    return write_table(_fact(spark, sf_dir), f"{folder}/fact"), folder


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact, _ = _written_fact(spark, sf_dir, "counts")
    return star.star_row_counts(star.build_star(fact))


def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraint checks over the loaded star tables."""
    fact, folder = _written_fact(spark, sf_dir, "star")
    tables = batch.load_star(fact, folder)
    return star.star_integrity(tables, fact)


def query_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact, folder = _written_fact(spark, sf_dir, "suite")
    clusters = fixed_tiers(summaries.product_features(fact))
    sqlsuite.register_views(star.build_star(fact) | {"product_clusters": clusters})
    return sqlsuite.run_query_suite(spark, f"{folder}/results")


def run_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole batch run; its two counts and the KPI row."""
    result = batch.run_pipeline(spark, raw_sales(spark, sf_dir), scratch_dir(spark, "batch"))
    return result.outputs["kpis"].select(
        F.lit(result.raw_rows).cast("bigint").alias("raw_rows"),
        F.lit(result.clean_rows).cast("bigint").alias("clean_rows"),
        "*",
    )


def run_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch run, star schema and k-means tiers; rows per written table."""
    tables = batch.run_full(spark, raw_sales(spark, sf_dir), scratch_dir(spark, "full"))
    return star.star_row_counts(tables)


# --- tiers, scenarios, dashboard ---------------------------------------------


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = tiers.scale_features(_features(spark, sf_dir))
    return z.select(
        "product_id", *(round_half_up(F.col(f"{f}_z"), 6).alias(f"{f}_z") for f in TIER_FEATURES)
    )


def _written_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product features as a table: the fits, the assignment and the labels all read them."""
    return write_table(_features(spark, sf_dir), scratch_dir(spark, "features") + "/products")


def kmeans_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered = tiers.kmeans_clusters(_written_features(spark, sf_dir))
    return clustered.select("product_id", *TIER_FEATURES, "cluster")


def kmeans_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers.demand_tiers(_written_features(spark, sf_dir))


def kmeans_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for the tiers of k-means whatever its seeds find."""
    features = _written_features(spark, sf_dir)
    tiered = write_table(tiers.demand_tiers(features), scratch_dir(spark, "tiers") + "/products")
    return tiers.clustering_check(tiered, tiers.seed_costs(features))


def fixed_cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelling step on given clusters."""
    clustered = _tiered(spark, sf_dir).drop("demand_level")
    return tiers.label_tiers(clustered).select(
        "product_id", "avg_daily_sales", "cluster", "demand_level"
    )


def _baseline(spark: SparkSession, sf_dir: str, by: tuple[str, ...] = ()) -> DataFrame:
    fact = _fact(spark, sf_dir)
    clusters = fixed_tiers(summaries.product_features(fact))
    return scenarios.scenario_baseline(star.fact_sales(fact), clusters, by)


def _forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.scenario_forecast(_baseline(spark, sf_dir))


def kpi_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.scenario_baseline_from_kpis(summaries.kpi_snapshot(_fact(spark, sf_dir)))


def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact, _ = _written_fact(spark, sf_dir, "headline")
    monthly = fact.groupBy("year", "month").agg(
        F.sum("sales_quantity").alias("units"),
        summaries.sum_money(F.col("revenue")).alias("revenue"),
    )
    clusters = fixed_tiers(summaries.product_features(fact))
    return dashboard.headline_kpis(
        monthly, star.dim_warehouse(fact), star.dim_store(fact), clusters
    )


_warehouses = _suite_query("api_warehouse_summary")
_monthly = _suite_query("api_sales_summary")


def queries() -> dict[str, Query]:
    registered: dict[str, Query] = {
        "ingest_csv": ingest_csv,
        "ingest_report": _on_raw(quality.ingest_report),
        "sink_table": sink_table,
        "sink_report_json": sink_report_json,
        "sink_replace": sink_replace,
        "load_processed": processed_round_trip,
        "dq_profile": _on_raw(quality.profile_dq),
        "drop_missing": _on_raw(quality.drop_missing),
        "drop_duplicates": _on_raw(quality.drop_duplicates),
        "drop_negative": _on_raw(quality.drop_negative),
        "cast_quantities": _on_raw(quality.cast_quantities),
        "clean_sales": _on_raw(quality.clean_sales),
        "dq_report": _on_raw(quality.dq_report),
        # The same on rows with every kind of dirt.
        "dirty_dq_profile": _on_dirty(quality.profile_dq),
        "dirty_dq_report": _on_dirty(quality.dq_report),
        "dirty_clean_sales": _on_dirty(quality.clean_sales),
        "dirty_enrich_sales": _on_dirty(lambda raw: enrich_sales(quality.clean_sales(raw))),
        "dirty_kpi_snapshot": _on_dirty(lambda raw: summaries.kpi_snapshot(enrich_sales(quality.clean_sales(raw)))),
        "require_columns": checked_features,
        "fill_missing_features": blanked_features,
        "enrich_sales": _fact,
        "date_attributes": _on_raw(date_attributes),
        "snake_case_columns": renamed_columns,
        "inventory_search": _on_tiers(
            lambda t: dashboard.inventory_search(dashboard.inventory_status(t), "  STOCKOUT ")
        ),
        "dim_warehouse": _on_fact(star.dim_warehouse),
        "dim_date": _on_fact(star.dim_date),
        "dim_store": _on_fact(star.dim_store),
        "dim_product": _on_fact(star.dim_product),
        "fact_sales": _on_fact(star.fact_sales),
        "star_row_counts": row_counts,
        "star_integrity": integrity,
        "stock_risk_bands": _on_fact(
            lambda f: summaries.stock_risk_bands(summaries.store_summary(f), "units_sold")
        ),
        "kpi_snapshot": _on_fact(summaries.kpi_snapshot),
        "run_query_suite": query_suite,
        "scale_features": scaled,
        "kmeans_clusters": kmeans_assignment,
        "demand_tiers": kmeans_tiers,
        "kmeans_check": kmeans_check,
        "demand_tier_labels": fixed_cluster_labels,
        "tier_sizes": _on_tiers(tiers.tier_sizes),
        "tier_scatter": _on_tiers(tiers.tier_scatter),
        "scenario_baseline": _baseline,
        "scenario_baseline_by_warehouse": lambda s, d: _baseline(s, d, ("warehouse_id",)),
        "scenario_baseline_from_kpis": kpi_baseline,
        "scenario_forecast": _forecast,
        "scenario_forecast_festival": lambda s, d: scenarios.scenario_forecast(
            _baseline(s, d), "Festival"
        ),
        "scenario_delta": lambda s, d: scenarios.scenario_delta(_forecast(s, d)),
        "headline_kpis": headline,
        "tier_share": _on_tiers(dashboard.tier_share),
        "warehouse_mini_stats": lambda s, d: dashboard.warehouse_mini_stats(_warehouses(s, d)),
        "inventory_status": _on_tiers(dashboard.inventory_status),
        "warehouse_velocity_risk": lambda s, d: dashboard.warehouse_velocity_risk(
            _warehouses(s, d), under=0.8, over=1.4
        ),
        "monthly_chart_series": lambda s, d: dashboard.monthly_chart_series(_monthly(s, d)),
        "run_batch": run_batch,
        "run_full": run_full,
    }
    registered |= {name: _report(name) for name in summaries.REPORT_ORDER}
    registered |= {name: _suite_query(name) for name in sqlsuite.QUERIES}
    return registered

"""The batch run: raw sales to written tables, then star schema and tiers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from salesmart.operators import quality, scenarios, star, summaries, tiers
from salesmart.operators.enrich import enrich_sales
from salesmart.plans import sqlsuite
from salesmart.session import concurrently
from salesmart.sources.readers import read_sales
from salesmart.sources.tables import write_report_json, write_table

SUMMARIES = {
    "warehouse_summary": summaries.warehouse_summary,
    "store_summary": summaries.store_summary,
    "product_features": summaries.product_features,
    "time_summary": summaries.time_summary,
}


def _units_by_warehouse(outputs: dict[str, DataFrame]) -> DataFrame:
    stores = outputs["store_summary"].withColumnRenamed("units_sold", "sales_quantity")
    return summaries.units_by_warehouse(stores)


def _top_products(outputs: dict[str, DataFrame]) -> DataFrame:
    products = outputs["product_features"].withColumnRenamed("total_sales", "sales_quantity")
    return summaries.top_products(products)


# Reports whose figures are sums of written summaries.
FROM_SUMMARIES = {"units_by_warehouse": _units_by_warehouse, "top_products": _top_products}


@dataclass
class BatchResult:
    """What a run returns: counts, the written tables and the KPI row.

    ``corrupt_rows`` counts lines of a raw file that could not be fully parsed.
    """

    raw_rows: int
    clean_rows: int
    corrupt_rows: int
    outputs: dict[str, DataFrame]
    kpis: dict


def _write_report(name: str, report: DataFrame, path: str, file_format: str) -> DataFrame:
    return write_table(summaries.in_report_order(report, name), path, file_format)


def run_pipeline(
    spark: SparkSession, raw: DataFrame | str, out_dir: str, file_format: str = "parquet"
) -> BatchResult:
    """Profile, clean, enrich, summarise and write.

    The raw data is scanned and shuffled once: the job that writes the clean fact
    also counts the raw and the clean rows and the days they span. Four summaries and
    the count of duplicates each read the written fact once, pruned to their columns;
    what adds up from a written summary is taken from there. Nothing has to stay cached
    and a lost executor costs only its running tasks.
    """
    if isinstance(raw, str):
        raw = read_sales(spark, raw, keep_corrupt=True)
    clean, raw_counts = quality.clean_and_observe(raw)
    enriched, clean_counts = quality.observe_clean(enrich_sales(clean))
    fact = write_table(enriched, f"{out_dir}/clean_sales")
    before, after = raw_counts.get, clean_counts.get

    jobs = {
        name: partial(_write_report, name, summary(fact), f"{out_dir}/{name}", file_format)
        for name, summary in SUMMARIES.items()
    }
    stages = quality.report_from_counts(before, after, quality.duplicate_sales(fact))
    jobs["dq_stages"] = partial(write_table, stages, f"{out_dir}/dq_stages")
    outputs = {"clean_sales": fact} | concurrently(spark, jobs)
    jobs = {
        name: partial(_write_report, name, report(outputs), f"{out_dir}/{name}", file_format)
        for name, report in FROM_SUMMARIES.items()
    }
    figures = summaries.kpis_from_summaries(
        outputs["store_summary"], outputs["product_features"], after["date_min"], after["date_max"]
    )
    jobs["kpis"] = partial(write_table, figures, f"{out_dir}/kpis")
    outputs |= concurrently(spark, jobs)
    kpis = outputs["kpis"]
    outputs["dq_report"] = write_report_json(outputs["dq_stages"], kpis, f"{out_dir}/dq_report")
    headline = kpis.first().asDict()
    return BatchResult(
        raw_rows=before["total_rows"],
        clean_rows=headline["transactions"],
        corrupt_rows=before.get("corrupt_rows", 0),
        outputs=outputs,
        kpis=headline,
    )


def load_star(fact: DataFrame, out_dir: str) -> dict[str, DataFrame]:
    """Writes the star schema tables."""
    tables = star.build_star(fact, with_sale_id=True)
    jobs = {
        name: partial(write_table, df, f"{out_dir}/{name}") for name, df in tables.items()
    }
    return concurrently(fact.sparkSession, jobs)


def run_full(
    spark: SparkSession, raw: DataFrame | str, out_dir: str, **kmeans_options
) -> dict[str, DataFrame]:
    """Batch run, star schema, demand tiers, forecasts and the SQL suite; an error in a stage ends the run there.

    Star schema and tiers need the written tables of the batch run only and run side by
    side. The suite's results are tables below ``queries``; ``query_suite`` tells how each went.
    """
    outputs = run_pipeline(spark, raw, out_dir).outputs

    def load_tiers() -> dict[str, DataFrame]:
        tiered = tiers.demand_tiers(outputs["product_features"], **kmeans_options)
        return {"product_clusters": write_table(tiered, f"{out_dir}/star/product_clusters")}

    loads = {"star": partial(load_star, outputs["clean_sales"], f"{out_dir}/star"), "tiers": load_tiers}
    loaded = concurrently(spark, loads)
    tables = loaded["star"] | loaded["tiers"]
    sqlsuite.register_views(tables)
    suite = sqlsuite.run_query_suite(spark, f"{out_dir}/queries")
    tables["query_suite"] = write_table(suite, f"{out_dir}/query_suite")
    baseline = scenarios.available_baseline(tables["fact_sales"], tables["product_clusters"], outputs["kpis"])
    forecast = scenarios.scenario_forecast(baseline)
    tables["scenario_forecast"] = write_table(forecast, f"{out_dir}/scenario_forecast", "json")
    return outputs | tables

"""Figures shown on the dashboard, computed as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.functions.dates import year_month_label
from salesmart.functions.numeric import (
    ratio_with_floor,
    round_half_up,
    round_whole,
    sum_money,
)
from salesmart.schema import TIER_LABELS


def _row_count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def headline_kpis(
    monthly: DataFrame, warehouses: DataFrame, stores: DataFrame, clusters: DataFrame
) -> DataFrame:
    """Revenue and units over the monthly table, with network and High-tier sizes."""
    zero = F.lit(0)
    return monthly.agg(
        F.coalesce(sum_money(F.col("revenue")), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.sum("units"), zero).cast("bigint").alias("total_units"),
    ).select(
        "*",
        _row_count(warehouses).alias("warehouses"),
        _row_count(stores).alias("stores"),
        _row_count(clusters.filter(F.col("demand_level") == "High")).alias("high_demand_products"),
    )


def tier_share(clusters: DataFrame) -> DataFrame:
    """Whole-percent share of the catalogue per tier; absent tiers show zero."""
    sizes = clusters.agg(
        F.count(F.lit(1)).alias("_total"),
        *(F.count_if(F.col("demand_level") == t).alias(t) for t in TIER_LABELS),
    )
    total = F.greatest(F.col("_total"), F.lit(1))
    return sizes.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(t).alias("demand_level"),
                        F.col(t).alias("products"),
                        round_whole(F.col(t) * 100 / total).alias("share_pct"),
                    )
                    for t in TIER_LABELS
                )
            )
        )
    )


def warehouse_mini_stats(warehouses: DataFrame) -> DataFrame:
    """Busiest warehouse, mean of the warehouse stock averages, network revenue."""
    top = F.max(F.struct("units_sold", (-F.col("warehouse_id")).alias("_rank")))
    return warehouses.agg(
        top.alias("_top"),
        round_whole(F.avg("avg_stock")).alias("avg_stock_per_warehouse"),
        sum_money(F.col("revenue")).alias("total_revenue"),
    ).select(
        (-F.col("_top._rank")).alias("top_warehouse_id"),
        F.col("_top.units_sold").alias("top_units_sold"),
        "avg_stock_per_warehouse",
        "total_revenue",
    )


def inventory_status(products: DataFrame) -> DataFrame:
    """Stock cover in days of sales and its status."""
    ratio = round_half_up(ratio_with_floor(F.col("avg_stock"), F.col("avg_daily_sales"), 0.1), 1)
    return products.select(
        "product_id",
        "demand_level",
        "avg_daily_sales",
        "avg_stock",
        ratio.alias("stock_ratio"),
        F.when(ratio < 2, "Stockout Risk").otherwise("Healthy").alias("status"),
    )


def _shown(value: Column, text: Column) -> Column:
    return F.when(value.isNull() | (value == 0), "—").otherwise(text)


def inventory_search(status: DataFrame, query: str) -> DataFrame:
    """Rows whose displayed text contains the trimmed query, ignoring case."""
    needle = query.strip().lower()
    if not needle:
        return status
    daily, stock = F.col("avg_daily_sales"), F.col("avg_stock")
    text = F.concat_ws(
        " ",
        F.concat(F.lit("#"), F.col("product_id").cast("string")),
        F.col("demand_level"),
        _shown(daily, F.format_string("%.1f", round_half_up(daily, 1))),
        _shown(stock, F.format_number(round_whole(stock), 0)),
        F.col("status"),
    )
    return status.filter(F.contains(F.lower(text), F.lit(needle)))


def warehouse_velocity_risk(
    warehouses: DataFrame, under: float = 4.5, over: float = 7.0
) -> DataFrame:
    """Stock per thousand units sold against two cut-offs."""
    per_thousand = ratio_with_floor(F.col("avg_stock"), F.col("units_sold") / F.lit(1000.0), 0.01)
    velocity = F.col("velocity_ratio")
    return warehouses.withColumn("velocity_ratio", round_half_up(per_thousand, 2)).withColumn(
        "velocity_risk",
        F.when(velocity < under, "Understock")
        .when(velocity > over, "Overstock")
        .otherwise("Balanced"),
    )


def monthly_chart_series(monthly: DataFrame) -> DataFrame:
    return monthly.select(
        year_month_label(F.col("year"), F.col("month")).alias("label"), "revenue", "units"
    )

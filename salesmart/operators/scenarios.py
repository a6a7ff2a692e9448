"""What-if demand scenarios over a sales baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.numeric import round_half_even, round_half_up

# Scenario name, demand multiplier, risk, recommendation.
SCENARIOS = [
    ("Normal", 1.05, "low", "Slight growth vs baseline; maintain current replenishment."),
    ("Festival", 1.4, "medium", "Spike in demand; pre-position stock for High-demand products."),
    ("Low demand", 0.8, "low", "Softer sales; reduce inbound to avoid overstock."),
    ("Supply disruption", 0.85, "medium", "Constrained availability; protect High-demand SKUs first."),
]

# Fixed value: what a rule-based forecast says of its origin.
EXPLANATION = "Rule-based forecast."
SCENARIO_NAMES = [name for name, *_ in SCENARIOS]

BASELINE = ["baseline_units", "baseline_stock", "high_demand_products", "baseline_from"]


def scenario_baseline(
    sales: DataFrame,
    clusters: DataFrame,
    by: Sequence[str] = (),
    source: str = "star_schema",
) -> DataFrame:
    """Units, stock and number of High-tier products; one row, or one per ``by`` group.

    ``baseline_stock`` adds up the stock snapshot of every sale line, so it is a
    size indicator, not stock on hand.
    """
    zero = F.lit(0)
    tag = F.lit(source).alias("baseline_from")
    high = clusters.filter(F.col("demand_level") == "High").select("product_id")
    if not by:
        high_count = high.agg(F.count(F.lit(1)).alias("n")).scalar()
        return sales.agg(
            F.coalesce(F.sum("sales_qty"), zero).cast("bigint").alias("baseline_units"),
            F.coalesce(F.sum("stock_qty"), zero).cast("bigint").alias("baseline_stock"),
        ).select("*", high_count.alias("high_demand_products"), tag)
    # Collapse to one row per group and product before meeting the tier table.
    per_product = sales.groupBy(*by, "product_id").agg(
        F.sum("sales_qty").alias("_units"), F.sum("stock_qty").alias("_stock")
    )
    flagged = per_product.join(high.distinct().withColumn("_high", F.lit(1)), "product_id", "left")
    return flagged.groupBy(*by).agg(
        F.sum("_units").alias("baseline_units"),
        F.sum("_stock").alias("baseline_stock"),
        F.count("_high").alias("high_demand_products"),
    ).select(*by, *BASELINE[:-1], tag)


def scenario_baseline_from_kpis(kpis: DataFrame, source: str = "spark_kpis") -> DataFrame:
    """Fallback baseline when only the KPI row exists: units, nothing else."""
    return kpis.select(
        F.col("total_units").cast("bigint").alias("baseline_units"),
        F.lit(0).cast("bigint").alias("baseline_stock"),
        F.lit(0).cast("bigint").alias("high_demand_products"),
        F.lit(source).alias("baseline_from"),
    )


def available_baseline(
    sales: DataFrame | None, clusters: DataFrame | None, kpis: DataFrame | None
) -> DataFrame:
    """The baseline of the star schema, or of the KPI row where no sale has units.

    Looks for one such sale, which needs no full scan; without sales and KPIs there is
    no baseline.
    """
    if sales is not None and not sales.where(F.col("sales_qty").isNotNull()).isEmpty():
        return scenario_baseline(sales, clusters)
    if kpis is None:
        raise ValueError("no baseline: neither sales nor KPIs; run the batch first")
    return scenario_baseline_from_kpis(kpis)


def scenario_forecast(baseline: DataFrame, scenario: str | None = None) -> DataFrame:
    """Expected units per scenario (all, or the named one) for every baseline row."""
    if scenario is not None and scenario not in SCENARIO_NAMES:
        raise ValueError(f"unknown scenario {scenario!r}; choose from {SCENARIO_NAMES}")
    chosen = [s for s in SCENARIOS if scenario in (None, s[0])]
    table = F.array(
        *(
            F.struct(
                F.lit(name).alias("scenario"),
                F.lit(multiplier).alias("multiplier"),
                F.lit(risk).alias("risk"),
                F.lit(note).alias("recommendation"),
            )
            for name, multiplier, risk, note in chosen
        )
    )
    groups = [c for c in baseline.columns if c not in BASELINE]
    return baseline.select("*", F.inline(table)).select(
        *groups,
        "scenario",
        "baseline_units",
        "baseline_stock",
        "high_demand_products",
        round_half_even(F.col("baseline_units") * F.col("multiplier")).alias("expected_units"),
        "risk",
        "recommendation",
        F.lit(EXPLANATION).alias("explanation"),
        F.lit("fallback").alias("source"),
        "baseline_from",
    )


def scenario_delta(forecast: DataFrame) -> DataFrame:
    """Adds the change against the baseline in percent, as number and signed text."""
    base, expected = F.col("baseline_units"), F.col("expected_units")
    change = F.when(
        (base != 0) & (expected != 0), round_half_up((expected - base) / base * 100, 1)
    )
    delta = F.col("delta_pct")
    return forecast.withColumn("delta_pct", change).withColumn(
        "delta_text", F.when(delta.isNotNull(), F.format_string("%+.1f%%", delta))
    )

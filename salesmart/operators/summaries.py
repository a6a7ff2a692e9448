"""Grouped summaries of the cleaned, enriched sales fact.

All measures are sums of integers (units, stock, cents, rows), so they combine
map-side and merge exactly. Distinct counts per group are exact: Spark expands the row
once per counted column and collapses each (key, value) pair map-side (for products, a
set per task), so a hot key leaves a task as its distinct values, never as its rows. Pass
``distinct=F.approx_count_distinct`` to trade exactness for a smaller shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesmart.functions.numeric import (
    from_cents,
    population_stddev,
    ratio_with_floor,
    round_half_up,
    sum_cents,
    sum_money,
    sum_whole,
)
from salesmart.functions.rows import bit_of, scalar_over, word_of

Counter = Callable[[str], Column]

# Row order in which a finished report is written. Operators do not sort.
REPORT_ORDER = {
    "units_by_warehouse": [("warehouse_id", "asc")],
    "warehouse_summary": [("warehouse_id", "asc")],
    "store_summary": [("revenue", "desc"), ("store_id", "asc"), ("warehouse_id", "asc")],
    "product_features": [("total_sales", "desc"), ("product_id", "asc"), ("product_name", "asc")],
    "time_summary": [("year", "asc"), ("month", "asc")],
    "top_products": [("rank", "asc")],
}


def in_report_order(df: DataFrame, report: str) -> DataFrame:
    keys = [F.desc(c) if way == "desc" else F.asc(c) for c, way in REPORT_ORDER[report]]
    return df.orderBy(*keys)


def _avg_stock() -> Column:
    return round_half_up(F.sum("stock_quantity") / F.count(F.lit(1)), 1)


def _measures() -> list[Column]:
    return [
        F.sum("sales_quantity").alias("units_sold"),
        sum_money(F.col("revenue")).alias("revenue"),
        _avg_stock().alias("avg_stock"),
        F.count(F.lit(1)).alias("txn_count"),
    ]


def units_by_warehouse(fact: DataFrame) -> DataFrame:
    """Map (warehouse, quantity), reduce by sum."""
    return fact.groupBy("warehouse_id").agg(F.sum("sales_quantity").alias("units_sold_mr"))


def warehouse_summary(fact: DataFrame, distinct: Counter = F.count_distinct) -> DataFrame:
    """Units, revenue, stock cover and stock risk per warehouse."""
    per_warehouse = fact.groupBy("warehouse_id").agg(
        *_measures(),
        distinct("product_id").alias("products"),
        distinct("store_id").alias("stores"),
    )
    cover = ratio_with_floor(F.col("avg_stock"), F.col("units_sold") / F.lit(1000.0), 0.01)
    return stock_risk_bands(
        per_warehouse.withColumn("stock_to_sales", round_half_up(cover, 2)), "stock_to_sales"
    )


def stock_risk_bands(
    df: DataFrame,
    metric: str,
    low: float = 0.33,
    high: float = 0.66,
    accuracy: int = 10000,
) -> DataFrame:
    """Label rows by two percentiles of ``metric``; at or below the low cut wins.

    The cuts are one scalar subquery, so the plan stays lazy and needs no join; it
    reads the same shuffle as the rows that are labelled.
    """
    cuts = scalar_over(df, cuts=F.percentile_approx(metric, [low, high], accuracy))["cuts"]
    value = F.col(metric)
    return df.withColumn(
        "stock_risk",
        F.when(value <= F.get(cuts, F.lit(0)), "understock")
        .when(value >= F.get(cuts, F.lit(1)), "overstock")
        .otherwise("balanced"),
    )


def store_summary(fact: DataFrame) -> DataFrame:
    return fact.groupBy("store_id", "warehouse_id").agg(*_measures())


def _size_of_set(column: str) -> Column:
    """A distinct count from a set that is built map-side, for values that are few per group."""
    return F.size(F.collect_set(column)).cast("bigint")


def product_features(fact: DataFrame, distinct: Counter = _size_of_set) -> DataFrame:
    """Demand and stock features per product.

    Daily sales divide by the days on which the product sold; volatility is the
    population deviation of line quantities.

    There are many products with a few days and stores each. Those are gathered as sets
    beside the sums, in one shuffle of a row per product and task, and in none where the
    sales lie by product already; expanded rows would be shuffled twice, three for each
    sale. A group's sets must fit a task's memory.
    """
    quantity = F.col("sales_quantity").cast("bigint")
    grouped = fact.groupBy("product_id", "product_name").agg(
        F.sum("sales_quantity").alias("total_sales"),
        sum_whole(quantity * quantity).alias("_squares"),
        F.sum("stock_quantity").alias("_stock"),
        F.count(F.lit(1)).alias("_rows"),
        sum_money(F.col("revenue")).alias("revenue"),
        round_half_up(F.avg("price"), 2).alias("avg_price"),
        distinct("date").alias("_days"),
        distinct("store_id").alias("store_count"),
    )
    rows = F.col("_rows")
    return grouped.select(
        "product_id",
        "product_name",
        "total_sales",
        round_half_up(F.col("total_sales") / F.col("_days"), 2).alias("avg_daily_sales"),
        round_half_up(
            population_stddev(rows, F.col("total_sales"), F.col("_squares")), 2
        ).alias("sales_volatility"),
        round_half_up(F.col("_stock") / rows, 1).alias("avg_stock"),
        "revenue",
        "avg_price",
        "store_count",
    ).withColumn(
        "stock_to_sales_ratio",
        round_half_up(ratio_with_floor(F.col("avg_stock"), F.col("avg_daily_sales"), 0.01), 2),
    )


def time_summary(fact: DataFrame) -> DataFrame:
    return fact.groupBy("year", "month").agg(*_measures())


def top_products(fact: DataFrame, n: int = 20) -> DataFrame:
    """Top ``n`` products by revenue with share and cumulative share of all revenue.

    The limit comes first (a distributed top-k), so the ranking window only ever
    sees ``n`` rows. The total is a second level over the same sums per product.
    """
    by_product = fact.groupBy("product_id", "product_name").agg(
        F.sum("sales_quantity").alias("units_sold"),
        sum_cents(F.col("revenue")).alias("_cents"),
    )
    # Zero or no revenue divides by one, so shares come out as zero.
    everything = F.try_sum("_cents")
    base = scalar_over(by_product, base=from_cents(F.when(everything != 0, everything).otherwise(100)))["base"]
    order = [F.desc("_cents"), F.asc("product_id"), F.asc("product_name")]
    ranked = Window.orderBy(*order)
    running = F.try_sum("_cents").over(ranked.rowsBetween(Window.unboundedPreceding, 0))

    def share(amount: Column) -> Column:
        return round_half_up(from_cents(amount) * 100.0 / F.col("_base"), 2)

    return (
        by_product.orderBy(*order)
        .limit(n)
        .withColumns({"rank": F.row_number().over(ranked), "_running": running})
        .withColumn("_base", base)
        .select(
            "product_id",
            "product_name",
            "units_sold",
            from_cents(F.col("_cents")).alias("revenue"),
            "rank",
            share(F.col("_cents")).alias("revenue_share_pct"),
            share(F.col("_running")).alias("cumulative_share_pct"),
        )
    )


def kpis_from_summaries(
    stores: DataFrame, products: DataFrame, date_min: str | None, date_max: str | None
) -> DataFrame:
    """:func:`kpi_snapshot` from the store and product summaries and the first and last day.

    Exact as long as a store's revenue is exact to the cent (below 9e13).
    """
    zero = F.lit(0)
    ids = products.agg(F.count_distinct("product_id").alias("n"))
    return stores.agg(
        F.coalesce(F.sum("txn_count"), zero).cast("bigint").alias("transactions"),
        F.coalesce(F.sum("units_sold"), zero).cast("bigint").alias("total_units"),
        from_cents(F.when(F.count("revenue") > 0, sum_cents(F.col("revenue"))).otherwise(zero)).alias("total_revenue"),
        F.count_distinct("store_id").alias("stores"),
        F.count_distinct("warehouse_id").alias("warehouses"),
    ).select(
        "transactions", "total_units", "total_revenue", ids.scalar().alias("products"), "stores", "warehouses",
        F.lit(date_min).cast("date").alias("date_min"), F.lit(date_max).cast("date").alias("date_max"),
    )


def kpi_snapshot(fact: DataFrame, distinct: Counter | None = None) -> DataFrame:
    """One row of headline figures; sums are 0 and dates null without input.

    Distinct ids are exact and need no expanded rows: ids are whole numbers, so sales
    are grouped by the 64 neighbours that each of their three ids is among, with a
    bitmap for each id, and the bitmaps of the groups are merged. That shrinks the fact
    as far as ids are dense; where they are scattered over all numbers, pass
    ``distinct=F.count_distinct`` (or ``F.approx_count_distinct``).
    """
    zero = F.lit(0)
    figures = [
        F.count(F.lit(1)).alias("transactions"),
        F.coalesce(F.sum("sales_quantity"), zero).cast("bigint").alias("total_units"),
        F.when(F.count("revenue") > 0, sum_cents(F.col("revenue"))).otherwise(zero).alias("_cents"),
        F.min("date").alias("date_min"),
        F.max("date").alias("date_max"),
    ]
    names = {"product_id": "products", "store_id": "stores", "warehouse_id": "warehouses"}
    if distinct is not None:
        snapshot = fact.agg(*figures, *(distinct(i).alias(n) for i, n in names.items()))
    else:
        words = [word_of(F.col(i)).alias(f"_word_{n}") for i, n in names.items()]
        bits = [F.bit_or(bit_of(F.col(i))).alias(f"_bits_{n}") for i, n in names.items()]
        groups = fact.groupBy(*words).agg(*figures, *bits)
        snapshot = _merged_bitmaps(groups, list(names.values()))
    return snapshot.select(
        "transactions", "total_units", from_cents(F.col("_cents")).alias("total_revenue"), *names.values(), "date_min", "date_max"
    )


def _merged_bitmaps(groups: DataFrame, names: list[str]) -> DataFrame:
    """Adds up groups of sales; a group's bitmaps meet those of the same words of other groups."""
    sums = ["transactions", "total_units", "_cents", "_lost"]
    groups = groups.withColumn("_lost", F.col("_cents").isNull().cast("int"))  # a total beyond all bounds stays one

    def entry(name: str, first: bool) -> Column:
        """One bitmap; the figures of the group go with the first."""
        figures = [F.when(F.lit(first), F.col(c)).alias(c) for c in (*sums, "date_min", "date_max")]
        return F.struct(
            F.lit(name).alias("_of"), F.col(f"_word_{name}").alias("_word"), F.col(f"_bits_{name}").alias("_bits"), *figures
        )

    bitmaps = groups.select(F.inline(F.array(*(entry(n, n == names[0]) for n in names))))
    merged = bitmaps.groupBy("_of", "_word").agg(
        F.bit_or("_bits").alias("_bits"),
        *(F.try_sum(c).alias(c) for c in sums),
        F.min("date_min").alias("date_min"),
        F.max("date_max").alias("date_max"),
    )
    counts = [
        F.coalesce(F.sum(F.when(F.col("_of") == n, F.bit_count("_bits"))), F.lit(0)).cast("bigint").alias(n) for n in names
    ]
    totals = merged.agg(
        *(F.coalesce(F.try_sum(c), F.lit(0)).alias(c) for c in sums),
        F.min("date_min").alias("date_min"),
        F.max("date_max").alias("date_max"),
        *counts,
    )
    known = totals.withColumn("_cents", F.when(F.col("_lost") == 0, F.col("_cents")))
    return known.withColumns({c: F.col(c).cast("bigint") for c in ("transactions", "total_units")})

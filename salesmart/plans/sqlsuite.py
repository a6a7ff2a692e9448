"""Named SQL over the star schema views.

Joins to a dimension come after the fact has been summed by the join key: the
sum combines map-side, so a hot product, store or day is one row per task before
anything is shuffled, and the join only sees one row per key. Money adds up as
whole cents and is exact. Every LIMIT has a total order.
"""

from __future__ import annotations

from functools import partial, reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.schema import TIER_LABELS
from salesmart.session import concurrently
from salesmart.sources.tables import write_table

# Whole cents summed in two halves, as in functions/numeric.py: no sum overflows.
_WHOLE = "rint(revenue * 100)"
_EXACT = f"abs({_WHOLE}) < 9007199254740992D"
_HIGH = f"CAST(floor(CASE WHEN {_EXACT} THEN {_WHOLE} END / 1e9D) AS BIGINT)"
_LOW = f"CAST(CASE WHEN {_EXACT} THEN {_WHOLE} END - {_HIGH} * 1e9D AS BIGINT)"
_ROUGH = f"SUM(CASE WHEN NOT {_EXACT} THEN {_WHOLE} END)"
_SUM = f"CAST(CAST(SUM({_HIGH}) AS DECIMAL(28,0)) * CAST(1000000000 AS DECIMAL(10,0)) + SUM({_LOW}) AS DECIMAL(38,0))"
CENTS = (
    f"(CASE WHEN {_ROUGH} IS NULL THEN {_SUM}"
    f" ELSE try_add(COALESCE({_SUM}, CAST(0 AS DECIMAL(38,0))), TRY_CAST({_ROUGH} AS DECIMAL(38,0))) END)"
)
TIER_ORDER = f"array_position(array{tuple(TIER_LABELS)}, demand_level)"


def _round(expression: str, digits: int) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


def _sales_by(key: str) -> str:
    return f"""
        SELECT {key}, SUM(sales_qty) AS units, {CENTS} AS cents
        FROM fact_sales
        GROUP BY {key}"""


QUERIES = {
    "q1_warehouse_units": f"""
        SELECT warehouse_id, SUM(sales_qty) AS units, CAST({CENTS} AS DOUBLE) / 100 AS revenue
        FROM fact_sales
        GROUP BY warehouse_id
        ORDER BY units DESC, warehouse_id""",
    "q2_top_products_by_name": f"""
        WITH sold AS ({_sales_by("product_id")})
        SELECT product_name, CAST(try_sum(cents) AS DOUBLE) / 100 AS revenue, SUM(units) AS units
        FROM sold JOIN dim_product USING (product_id)
        GROUP BY product_name
        ORDER BY revenue DESC, product_name
        LIMIT 10""",
    "q3_monthly_trend": f"""
        WITH sold AS ({_sales_by("date_id")})
        SELECT d.year, d.month, SUM(s.units) AS units, CAST(SUM(s.cents) AS DOUBLE) / 100 AS revenue
        FROM sold s JOIN dim_date d ON d.date_id = s.date_id
        GROUP BY d.year, d.month
        ORDER BY d.year, d.month""",
    "q4_stockout_risk": f"""
        SELECT product_id, demand_level,
               {_round("avg_daily_sales", 1)} AS avg_daily,
               {_round("avg_stock", 1)} AS avg_stock
        FROM product_clusters
        WHERE avg_stock < 2 * avg_daily_sales
        ORDER BY avg_daily_sales DESC, product_id""",
    "q5_tier_rollup": f"""
        SELECT demand_level, COUNT(*) AS products,
               {_round("AVG(avg_daily_sales)", 2)} AS avg_daily_sales,
               CAST({CENTS} AS DOUBLE) / 100 AS total_revenue
        FROM product_clusters
        GROUP BY demand_level
        ORDER BY {TIER_ORDER}""",
    "q6_weekend_split": f"""
        WITH sold AS ({_sales_by("date_id")})
        SELECT CASE WHEN weekday IN (5, 6) THEN 'weekend' ELSE 'weekday' END AS day_type,
               SUM(units) AS units, CAST(try_sum(cents) AS DOUBLE) / 100 AS revenue
        FROM sold JOIN dim_date USING (date_id)
        GROUP BY day_type""",
    "q7_store_in_warehouse": f"""
        WITH sold AS ({_sales_by("store_id")})
        SELECT w.warehouse_id, w.store_id, s.units, CAST(s.cents AS DOUBLE) / 100 AS revenue
        FROM sold s JOIN dim_store w ON w.store_id = s.store_id
        ORDER BY w.warehouse_id, revenue DESC, w.store_id""",
    "api_sales_summary": f"""
        WITH sold AS ({_sales_by("date_id")})
        SELECT year, month, SUM(units) AS units, CAST(try_sum(cents) AS DOUBLE) / 100 AS revenue
        FROM sold JOIN dim_date USING (date_id)
        GROUP BY 1, 2
        ORDER BY 1, 2""",
    "api_warehouse_summary": f"""
        SELECT warehouse_id, SUM(sales_qty) AS units_sold,
               {_round("SUM(stock_qty) / COUNT(*)", 1)} AS avg_stock,
               CAST({CENTS} AS DOUBLE) / 100 AS revenue
        FROM fact_sales
        GROUP BY 1
        ORDER BY 1""",
    "api_inventory_top": """
        SELECT product_id, demand_level, avg_daily_sales, avg_stock
        FROM product_clusters
        ORDER BY avg_daily_sales DESC, product_id
        LIMIT 50""",
    "api_tier_counts": f"""
        SELECT demand_level, COUNT(*) AS products
        FROM product_clusters
        GROUP BY 1
        ORDER BY {TIER_ORDER}""",
}


def register_views(tables: dict[str, DataFrame]) -> None:
    """Star tables (and ``product_clusters``) as temp views, open to any SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_named(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(QUERIES[name])


def run_query_suite(
    spark: SparkSession, out_dir: str, queries: dict[str, str] | None = None
) -> DataFrame:
    """Runs every named query over the registered views and writes its result.

    A failing query is reported with its error and does not stop the others.
    Returns (query, status, row_count, error).
    """
    texts = QUERIES if queries is None else queries
    jobs = {q: partial(_run_one, spark, q, text, f"{out_dir}/{q}") for q, text in texts.items()}
    return reduce(DataFrame.unionByName, concurrently(spark, jobs).values())


def _run_one(spark: SparkSession, name: str, text: str, path: str) -> DataFrame:
    try:
        written = write_table(spark.sql(text), path)
    except (PySparkException, Py4JJavaError) as problem:  # the latter from sources and sinks
        message = str(problem).strip().split("\n\n")[0]
        return _outcome(spark.range(1), name, "failed", F.lit(0), F.lit(message))
    counted = written.agg(F.count(F.lit(1)).alias("_rows"))
    return _outcome(counted, name, "ok", F.col("_rows"), F.lit(None))


def _outcome(df: DataFrame, name: str, status: str, rows, error) -> DataFrame:
    return df.select(
        F.lit(name).alias("query"),
        F.lit(status).alias("status"),
        rows.cast("bigint").alias("row_count"),
        error.cast("string").alias("error"),
    )

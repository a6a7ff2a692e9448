"""DuckDB SQL for every registered query whose result SQL can state.

Written against the given tables only, independently of the Spark plans: the
raw rows are a UNION ALL, the star joins run on the fact, money adds up in
DECIMAL, dimensions use ROW_NUMBER.
"""

from __future__ import annotations

# Fixed values, stated here so that a wrong one in the operator shows.
TIER_FEATURES = ["total_sales", "avg_daily_sales", "sales_volatility", "avg_stock", "revenue"]
PRIMARY_KEYS = {
    "dim_warehouse": "warehouse_id",
    "dim_store": "store_id",
    "dim_product": "product_id",
    "dim_date": "date_id",
}
FACT_KEYS = {
    "date_id": "dim_date",
    "product_id": "dim_product",
    "store_id": "dim_store",
    "warehouse_id": "dim_warehouse",
}
NOT_NULL = {
    "dim_store": ["warehouse_id"],
    "dim_product": ["product_name", "price"],
    "dim_date": ["full_date", "year", "month", "day", "weekday"],
    "fact_sales": ["date_id", "product_id", "store_id", "warehouse_id", "sales_qty", "stock_qty", "revenue"],
}
SCENARIOS = [
    ("Normal", 1.05, "low", "Slight growth vs baseline; maintain current replenishment."),
    ("Festival", 1.4, "medium", "Spike in demand; pre-position stock for High-demand products."),
    ("Low demand", 0.8, "low", "Softer sales; reduce inbound to avoid overstock."),
    ("Supply disruption", 0.85, "medium", "Constrained availability; protect High-demand SKUs first."),
]
EXPLANATION = "Rule-based forecast."


def _round(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,9)), {n}) AS DOUBLE)"


def _money(x: str = "revenue") -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(18,2))) AS DOUBLE)"


def _bigint(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


RAW = "date, product_id, product_name, store_id, warehouse_id, sales_quantity, stock_quantity, price, revenue"
KEYS_PRESENT = (
    "date IS NOT NULL AND product_id IS NOT NULL AND store_id IS NOT NULL AND warehouse_id IS NOT NULL"
    " AND sales_quantity IS NOT NULL AND stock_quantity IS NOT NULL AND price IS NOT NULL"
)

DATE_PARTS = """CAST(strftime(day_value, '%Y%m%d') AS INT) AS date_id,
    strftime(day_value, '%Y-%m-%d') AS full_date,
    CAST(year(day_value) AS INT) AS year, CAST(month(day_value) AS INT) AS month,
    CAST(day(day_value) AS INT) AS day, CAST(isodow(day_value) - 1 AS INT) AS weekday"""

MEASURES = f"""{_bigint("SUM(sales_quantity)")} AS units_sold, {_money()} AS revenue,
    {_round("AVG(stock_quantity)", 1)} AS avg_stock, COUNT(*) AS txn_count"""

PREFIX = f"""
WITH base AS (
  SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date,
         l_partkey AS product_id, p_name AS product_name,
         l_suppkey AS store_id, s_nationkey AS warehouse_id,
         l_orderkey AS k,
         CASE WHEN l_orderkey % 300 = 0 THEN NULL ELSE l_quantity END AS sales_quantity,
         CASE WHEN l_orderkey % 600 = 1 THEN CAST(-5 AS DOUBLE)
              ELSE CAST(20 + (l_orderkey*7 + l_linenumber*13 + l_partkey*3) % 80 AS DOUBLE)
         END AS stock_quantity,
         p_retailprice AS price, CAST(NULL AS DOUBLE) AS revenue
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
raw AS (SELECT {RAW} FROM base UNION ALL SELECT {RAW} FROM base WHERE k % 400 = 2),
clean AS (
  SELECT date, product_id, product_name, store_id, warehouse_id,
         CAST(trunc(sales_quantity) AS INT) AS sales_quantity,
         CAST(trunc(stock_quantity) AS INT) AS stock_quantity, price, revenue
  FROM (SELECT DISTINCT * FROM raw WHERE {KEYS_PRESENT})
  WHERE sales_quantity >= 0 AND stock_quantity >= 0),
fact AS (
  SELECT CAST(date AS DATE) AS date, product_id, product_name, store_id, warehouse_id,
         sales_quantity, stock_quantity, price,
         {_round("sales_quantity * price", 2)} AS revenue,
         CAST(year(CAST(date AS DATE)) AS INT) AS year,
         CAST(month(CAST(date AS DATE)) AS INT) AS month,
         CAST(weekofyear(CAST(date AS DATE)) AS INT) AS week,
         CAST(dayofweek(CAST(date AS DATE)) + 1 AS INT) AS day_of_week,
         CAST(CASE WHEN isodow(CAST(date AS DATE)) >= 6 THEN 1 ELSE 0 END AS INT) AS is_weekend
  FROM clean),
product_features AS (
  SELECT *, {_round("avg_stock / greatest(avg_daily_sales, 0.01::DOUBLE)", 2)} AS stock_to_sales_ratio
  FROM (SELECT product_id, product_name, {_bigint("SUM(sales_quantity)")} AS total_sales,
               {_round("SUM(sales_quantity)::DOUBLE / COUNT(DISTINCT date)", 2)} AS avg_daily_sales,
               {_round("stddev_pop(sales_quantity)", 2)} AS sales_volatility,
               {_round("AVG(stock_quantity)", 1)} AS avg_stock, {_money()} AS revenue,
               {_round("AVG(price)", 2)} AS avg_price, COUNT(DISTINCT store_id) AS store_count
        FROM fact GROUP BY product_id, product_name)),
product_clusters AS (
  SELECT *, CAST(CASE demand_level WHEN 'Low' THEN 2 WHEN 'Medium' THEN 0 ELSE 1 END AS INT) AS cluster
  FROM (SELECT *, CASE WHEN avg_daily_sales < 24 THEN 'Low' WHEN avg_daily_sales < 27 THEN 'Medium'
                       ELSE 'High' END AS demand_level FROM product_features)),
dim_warehouse AS (SELECT DISTINCT warehouse_id FROM fact),
dim_store AS (
  SELECT store_id, warehouse_id FROM fact
  QUALIFY ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY date, warehouse_id) = 1),
dim_product AS (
  SELECT product_id, product_name, price FROM fact
  QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id
                             ORDER BY date, product_name NULLS FIRST, price) = 1),
dim_date AS (SELECT {DATE_PARTS} FROM (SELECT DISTINCT date AS day_value FROM fact)),
fact_sales AS (
  SELECT CAST(strftime(date, '%Y%m%d') AS INT) AS date_id, product_id, store_id, warehouse_id,
         sales_quantity AS sales_qty, stock_quantity AS stock_qty, revenue FROM fact),
warehouse_base AS (
  SELECT warehouse_id, {MEASURES},
         COUNT(DISTINCT product_id) AS products, COUNT(DISTINCT store_id) AS stores
  FROM fact GROUP BY warehouse_id),
warehouse_cover AS (
  SELECT *, {_round("avg_stock / greatest(units_sold / 1000::DOUBLE, 0.01::DOUBLE)", 2)} AS stock_to_sales
  FROM warehouse_base),
api_warehouse AS (
  SELECT warehouse_id, {_bigint("SUM(sales_qty)")} AS units_sold,
         {_round("AVG(stock_qty)", 1)} AS avg_stock, {_money()} AS revenue
  FROM fact_sales GROUP BY warehouse_id),
monthly AS (
  SELECT d.year, d.month, {_bigint("SUM(f.sales_qty)")} AS units, {_money("f.revenue")} AS revenue
  FROM fact_sales f JOIN dim_date d USING (date_id) GROUP BY d.year, d.month),
kpis AS (
  SELECT COUNT(*) AS transactions, {_bigint("COALESCE(SUM(sales_quantity), 0)")} AS total_units,
         COALESCE({_money()}, 0) AS total_revenue, COUNT(DISTINCT product_id) AS products,
         COUNT(DISTINCT store_id) AS stores, COUNT(DISTINCT warehouse_id) AS warehouses,
         MIN(date) AS date_min, MAX(date) AS date_max FROM fact),
before_counts AS (
  SELECT 'before_clean' AS stage, COUNT(*) AS total_rows,
         COUNT(*) FILTER (NOT ({KEYS_PRESENT})) AS null_any_key_field,
         COUNT(*) FILTER (sales_quantity IS NULL) AS null_sales_quantity,
         COUNT(*) FILTER (stock_quantity IS NULL) AS null_stock_quantity,
         COUNT(*) FILTER (sales_quantity < 0) AS negative_sales,
         COUNT(*) FILTER (stock_quantity < 0) AS negative_stock,
         COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM raw)) AS duplicate_rows FROM raw),
after_counts AS (
  SELECT 'after_clean' AS stage, COUNT(*) AS total_rows,
         COUNT(*) FILTER (NOT ({KEYS_PRESENT})) AS null_any_key_field,
         COUNT(*) FILTER (sales_quantity IS NULL) AS null_sales_quantity,
         COUNT(*) FILTER (stock_quantity IS NULL) AS null_stock_quantity,
         COUNT(*) FILTER (sales_quantity < 0) AS negative_sales,
         COUNT(*) FILTER (stock_quantity < 0) AS negative_stock,
         COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM fact)) AS duplicate_rows FROM fact),
dq AS (
  SELECT a.*, CAST(NULL AS BIGINT) AS rows_removed, CAST(NULL AS DOUBLE) AS pct_removed FROM before_counts a
  UNION ALL
  SELECT b.*, a.total_rows - b.total_rows,
         {_round("100::DOUBLE * (a.total_rows - b.total_rows) / greatest(a.total_rows, 1)", 2)}
  FROM after_counts b, before_counts a),
baseline AS (
  SELECT {_bigint("SUM(sales_qty)")} AS baseline_units, {_bigint("SUM(stock_qty)")} AS baseline_stock,
         (SELECT COUNT(*) FROM product_clusters WHERE demand_level = 'High') AS high_demand_products,
         'star_schema' AS baseline_from FROM fact_sales),
scenarios(scenario, multiplier, risk, recommendation) AS (VALUES {", ".join(
    f"('{n}', {m}::DOUBLE, '{r}', '{t}')" for n, m, r, t in SCENARIOS)}),
forecast AS (
  SELECT scenario, baseline_units, baseline_stock, high_demand_products,
         {_bigint("round_even(baseline_units * multiplier, 0)")} AS expected_units,
         risk, recommendation, '{EXPLANATION}' AS explanation, 'fallback' AS source, baseline_from
  FROM baseline, scenarios),
inventory AS (
  SELECT *, CASE WHEN stock_ratio < 2 THEN 'Stockout Risk' ELSE 'Healthy' END AS status
  FROM (SELECT product_id, demand_level, avg_daily_sales, avg_stock,
               {_round("avg_stock / greatest(avg_daily_sales, 0.1::DOUBLE)", 1)} AS stock_ratio
        FROM product_clusters))
"""

def _usable(column: str) -> str:
    """Null and non-finite numbers are no values."""
    return f"({column} IS NOT NULL AND isfinite({column}))"


DIRTY_KEYS = (
    "(date IS NOT NULL AND product_id IS NOT NULL AND store_id IS NOT NULL AND warehouse_id IS NOT NULL"
    f" AND {_usable('sales_quantity')} AND {_usable('stock_quantity')} AND {_usable('price')})"
)


def _dirty_counts(stage: str, table: str, distinct: str) -> str:
    return f"""SELECT '{stage}' AS stage, COUNT(*) AS total_rows,
        COUNT(*) FILTER (NOT {DIRTY_KEYS}) AS null_any_key_field,
        COUNT(*) FILTER (NOT {_usable("sales_quantity")}) AS null_sales_quantity,
        COUNT(*) FILTER (NOT {_usable("stock_quantity")}) AS null_stock_quantity,
        COUNT(*) FILTER (sales_quantity < 0) AS negative_sales,
        COUNT(*) FILTER (stock_quantity < 0) AS negative_stock,
        COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {distinct} FROM {table})) AS duplicate_rows FROM {table}"""


SALE = "date, product_id, product_name, store_id, warehouse_id, sales_quantity, stock_quantity, price"

DIRTY_PREFIX = f"""
WITH lines AS (
  SELECT l_orderkey AS k, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped,
         l_partkey AS product_id, l_suppkey AS store_id, s_nationkey AS warehouse_id,
         CASE WHEN l_orderkey % 300 = 0 THEN NULL ELSE l_quantity END AS qty,
         CASE WHEN l_orderkey % 600 = 1 THEN CAST(-5 AS DOUBLE)
              ELSE CAST(20 + (l_orderkey*7 + l_linenumber*13 + l_partkey*3) % 80 AS DOUBLE) END AS stock,
         p_name, p_retailprice
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
base AS (
  SELECT k, CASE WHEN k % 110 = 3 THEN 'not a date' WHEN k % 130 = 4 THEN NULL ELSE shipped END AS date,
         product_id, CASE WHEN k % 70 = 5 THEN NULL ELSE p_name END AS product_name, store_id, warehouse_id,
         CASE WHEN k % 90 = 6 THEN -qty WHEN k % 100 = 7 THEN 'NaN'::DOUBLE WHEN k % 80 = 8 THEN 3e9::DOUBLE
              WHEN k % 20 = 9 THEN qty + 0.75 ELSE qty END AS sales_quantity,
         CASE WHEN k % 120 = 10 THEN NULL WHEN k % 140 = 11 THEN 'Infinity'::DOUBLE
              WHEN k % 30 = 12 THEN stock + 0.25 ELSE stock END AS stock_quantity,
         CASE WHEN k % 150 = 13 THEN NULL ELSE p_retailprice END AS price, CAST(NULL AS DOUBLE) AS revenue
  FROM lines),
raw AS (
  SELECT {RAW} FROM base WHERE k % 40 NOT IN (14, 15)
  UNION ALL SELECT {RAW} FROM base WHERE k % 400 = 2
  UNION ALL SELECT {RAW.replace("revenue", "copy")} FROM base, (VALUES (3::DOUBLE), (4::DOUBLE), (4::DOUBLE)) c(copy) WHERE k % 40 = 14
  UNION ALL SELECT {RAW.replace("revenue", "5::DOUBLE")} FROM base WHERE k % 40 = 15
  UNION ALL SELECT {RAW.replace("sales_quantity", "sales_quantity + 0.5").replace("revenue", "6::DOUBLE")} FROM base WHERE k % 40 = 15),
clean AS (
  SELECT date, product_id, product_name, store_id, warehouse_id, CAST(trunc(sales_quantity) AS INT) AS sales_quantity,
         CAST(trunc(stock_quantity) AS INT) AS stock_quantity, price, revenue
  FROM (SELECT DISTINCT * FROM raw
        WHERE {DIRTY_KEYS} AND sales_quantity >= 0 AND stock_quantity >= 0 AND sales_quantity < 2147483648)),
fact AS (
  SELECT TRY_CAST(date AS DATE) AS date, product_id, product_name, store_id, warehouse_id, sales_quantity, stock_quantity, price,
         {_round("sales_quantity * price", 2)} AS revenue,
         CAST(year(TRY_CAST(date AS DATE)) AS INT) AS year, CAST(month(TRY_CAST(date AS DATE)) AS INT) AS month,
         CAST(weekofyear(TRY_CAST(date AS DATE)) AS INT) AS week, CAST(dayofweek(TRY_CAST(date AS DATE)) + 1 AS INT) AS day_of_week,
         CAST(CASE WHEN isodow(TRY_CAST(date AS DATE)) >= 6 THEN 1 ELSE 0 END AS INT) AS is_weekend
  FROM clean WHERE date <> 'not a date'),
before_counts AS ({_dirty_counts("before_clean", "raw", "*")}),
after_counts AS ({_dirty_counts("after_clean", "fact", SALE)})
"""

DIRTY_BODIES = {
    "dirty_dq_profile": "SELECT * FROM before_counts",
    "dirty_dq_report": f"""SELECT a.*, CAST(NULL AS BIGINT) AS rows_removed, CAST(NULL AS DOUBLE) AS pct_removed FROM before_counts a
        UNION ALL SELECT b.*, a.total_rows - b.total_rows,
          {_round("100::DOUBLE * (a.total_rows - b.total_rows) / greatest(a.total_rows, 1)", 2)}
        FROM after_counts b, before_counts a""",
    "dirty_clean_sales": "SELECT * FROM clean",
    "dirty_enrich_sales": "SELECT * FROM fact",
    "dirty_kpi_snapshot": f"""SELECT COUNT(*) AS transactions, {_bigint("COALESCE(SUM(sales_quantity), 0)")} AS total_units,
        COALESCE({_money()}, 0) AS total_revenue, COUNT(DISTINCT product_id) AS products,
        COUNT(DISTINCT store_id) AS stores, COUNT(DISTINCT warehouse_id) AS warehouses,
        MIN(date) AS date_min, MAX(date) AS date_max FROM fact""",
}

DIMENSION_COUNTS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}"
    for t in ["dim_warehouse", "dim_store", "dim_product", "dim_date", "fact_sales"]
)


def _integrity() -> str:
    def check(table: str, kind: str, column: str, violations: str) -> str:
        return (
            f"SELECT '{table}' AS table_name, '{kind}' AS check_type, '{column}' AS column_name,"
            f" CAST(({violations}) AS BIGINT) AS violations"
        )

    checks = [
        check(t, "unique", k, f"SELECT COUNT(*) - COUNT(DISTINCT {k}) FROM {t}")
        for t, k in PRIMARY_KEYS.items()
    ]
    checks += [
        check(t, "not_null", c, f"SELECT COUNT(*) FROM {t} WHERE {c} IS NULL")
        for t, columns in NOT_NULL.items()
        for c in columns
    ]
    # Spark numbers the sales, so that all differ; tests repeat numbers to see the check fail.
    checks.append(check("fact_sales", "unique", "sale_id", "SELECT 0"))
    references = [("dim_store", "warehouse_id", "dim_warehouse")]
    references += [("fact_sales", c, d) for c, d in FACT_KEYS.items()]
    checks += [
        check(t, "foreign_key", c, f"SELECT COUNT(*) FROM {t} WHERE {c} NOT IN (SELECT {c} FROM {d})")
        for t, c, d in references
    ]
    checks.append(
        check("dim_store", "conflict", "store_id",
              "SELECT COUNT(*) FROM (SELECT store_id FROM fact GROUP BY 1 HAVING COUNT(DISTINCT warehouse_id) > 1)")
    )
    checks.append(
        check("dim_product", "conflict", "product_id",
              "SELECT COUNT(*) FROM (SELECT product_id FROM (SELECT DISTINCT product_id, product_name, price"
              " FROM fact) GROUP BY 1 HAVING COUNT(*) > 1)")
    )
    return " UNION ALL ".join(checks)


def _bands(source: str, metric: str) -> str:
    return f"""SELECT s.*, CASE WHEN {metric} <= p33 THEN 'understock' WHEN {metric} >= p66 THEN 'overstock'
        ELSE 'balanced' END AS stock_risk
      FROM {source} s, (SELECT quantile_disc({metric}, 0.33) AS p33, quantile_disc({metric}, 0.66) AS p66
                        FROM {source})"""


def _suite_rows() -> str:
    sizes = {
        "q1_warehouse_units": "SELECT COUNT(*) FROM dim_warehouse",
        "q2_top_products_by_name": "SELECT least(10, COUNT(DISTINCT product_name)) FROM dim_product",
        "q3_monthly_trend": "SELECT COUNT(*) FROM monthly",
        "q4_stockout_risk": "SELECT COUNT(*) FROM product_clusters WHERE avg_stock < 2 * avg_daily_sales",
        "q5_tier_rollup": "SELECT COUNT(DISTINCT demand_level) FROM product_clusters",
        "q6_weekend_split": "SELECT COUNT(DISTINCT weekday >= 5) FROM dim_date",
        "q7_store_in_warehouse": "SELECT COUNT(*) FROM dim_store",
        "api_sales_summary": "SELECT COUNT(*) FROM monthly",
        "api_warehouse_summary": "SELECT COUNT(*) FROM dim_warehouse",
        "api_inventory_top": "SELECT least(50, COUNT(*)) FROM product_clusters",
        "api_tier_counts": "SELECT COUNT(DISTINCT demand_level) FROM product_clusters",
    }
    return " UNION ALL ".join(
        f"SELECT '{q}' AS query, 'ok' AS status, CAST(({n}) AS BIGINT) AS row_count,"
        " CAST(NULL AS VARCHAR) AS error"
        for q, n in sizes.items()
    )


def _z_scores() -> str:
    columns = ", ".join(
        _round(
            f"({f} - AVG({f}) OVER ()) / CASE WHEN stddev_pop({f}) OVER () = 0 THEN 1"
            f" ELSE stddev_pop({f}) OVER () END",
            6,
        )
        + f" AS {f}_z"
        for f in TIER_FEATURES
    )
    return f"SELECT product_id, {columns} FROM product_features"


RAW_TYPES = [
    ("date", "string"),
    ("product_id", "bigint"),
    ("product_name", "string"),
    ("store_id", "bigint"),
    ("warehouse_id", "int"),
    ("sales_quantity", "double"),
    ("stock_quantity", "double"),
    ("price", "double"),
    ("revenue", "double"),
]

FEATURES = ", ".join(TIER_FEATURES)

BODIES = {
    "ingest_csv": f"""SELECT date, CAST(product_id AS INT) AS product_id, product_name,
        CAST(store_id AS INT) AS store_id, warehouse_id, sales_quantity, stock_quantity, price, revenue
        FROM raw""",
    "ingest_report": "SELECT t.position, t.column_name, t.data_type, n.row_count FROM (VALUES "
    + ", ".join(f"(CAST({i} AS INT), '{c}', '{t}')" for i, (c, t) in enumerate(RAW_TYPES, 1))
    + ") t(position, column_name, data_type), (SELECT COUNT(*) AS row_count FROM raw) n",
    "sink_table": f"SELECT store_id, warehouse_id, {MEASURES} FROM fact GROUP BY store_id, warehouse_id",
    "sink_report_json": "SELECT * FROM dq, kpis",
    "sink_replace": f"""SELECT date, is_weekend, {_bigint("SUM(sales_quantity)")} AS units
        FROM fact GROUP BY date, is_weekend""",
    "load_processed": "SELECT * FROM fact",
    "dq_profile": "SELECT * FROM before_counts",
    "drop_missing": f"SELECT * FROM raw WHERE {KEYS_PRESENT}",
    "drop_duplicates": "SELECT DISTINCT * FROM raw",
    "drop_negative": "SELECT * FROM raw WHERE sales_quantity >= 0 AND stock_quantity >= 0",
    "cast_quantities": """SELECT date, product_id, product_name, store_id, warehouse_id,
        CAST(trunc(sales_quantity) AS INT) AS sales_quantity,
        CAST(trunc(stock_quantity) AS INT) AS stock_quantity, price, revenue FROM raw""",
    "clean_sales": "SELECT * FROM clean",
    "dq_report": "SELECT * FROM dq",
    "require_columns": f"SELECT product_id, {FEATURES} FROM product_features",
    "fill_missing_features": """SELECT product_id, CAST(total_sales AS DOUBLE) AS total_sales, avg_daily_sales,
        CASE WHEN store_count >= 28 THEN sales_volatility ELSE 0 END AS sales_volatility,
        CASE WHEN avg_price < 920 THEN 0 ELSE avg_stock END AS avg_stock, revenue FROM product_features""",
    "enrich_sales": "SELECT * FROM fact",
    "date_attributes": f"SELECT {DATE_PARTS} FROM (SELECT DISTINCT CAST(date AS DATE) AS day_value FROM raw)",
    "snake_case_columns": "SELECT * FROM raw",
    "inventory_search": "SELECT * FROM inventory WHERE status = 'Stockout Risk'",
    "dim_warehouse": "SELECT * FROM dim_warehouse",
    "dim_date": "SELECT * FROM dim_date",
    "dim_store": "SELECT * FROM dim_store",
    "dim_product": "SELECT * FROM dim_product",
    "fact_sales": "SELECT * FROM fact_sales",
    "star_row_counts": DIMENSION_COUNTS,
    "star_integrity": _integrity(),
    "units_by_warehouse": f"""SELECT warehouse_id, {_bigint("SUM(sales_quantity)")} AS units_sold_mr
        FROM fact GROUP BY warehouse_id""",
    "warehouse_summary": _bands("warehouse_cover", "stock_to_sales"),
    "stock_risk_bands": _bands(
        f"(SELECT store_id, warehouse_id, {MEASURES} FROM fact GROUP BY store_id, warehouse_id)", "units_sold"
    ),
    "store_summary": f"SELECT store_id, warehouse_id, {MEASURES} FROM fact GROUP BY store_id, warehouse_id",
    "product_features": "SELECT * FROM product_features",
    "time_summary": f"SELECT year, month, {MEASURES} FROM fact GROUP BY year, month",
    "kpi_snapshot": "SELECT * FROM kpis",
    "top_products": f"""SELECT product_id, product_name, units_sold, revenue, CAST(rank AS INT) AS rank,
          {_round("100::DOUBLE * revenue / total", 2)} AS revenue_share_pct,
          {_round("100::DOUBLE * CAST(running AS DOUBLE) / total", 2)} AS cumulative_share_pct
        FROM (SELECT *, CAST(SUM(exact) OVER () AS DOUBLE) AS total,
                     SUM(exact) OVER (ORDER BY revenue DESC, product_id ROWS UNBOUNDED PRECEDING) AS running,
                     ROW_NUMBER() OVER (ORDER BY revenue DESC, product_id) AS rank
              FROM (SELECT product_id, product_name, {_bigint("SUM(sales_quantity)")} AS units_sold,
                           {_money()} AS revenue, SUM(CAST(revenue AS DECIMAL(18,2))) AS exact
                    FROM fact GROUP BY product_id, product_name))
        WHERE rank <= 20""",
    "q1_warehouse_units": f"""SELECT warehouse_id, {_bigint("SUM(sales_qty)")} AS units, {_money()} AS revenue
        FROM fact_sales GROUP BY warehouse_id""",
    "q2_top_products_by_name": f"""SELECT p.product_name, {_money("f.revenue")} AS revenue,
          {_bigint("SUM(f.sales_qty)")} AS units
        FROM fact_sales f JOIN dim_product p ON p.product_id = f.product_id
        GROUP BY p.product_name ORDER BY 2 DESC, 1 LIMIT 10""",
    "q3_monthly_trend": "SELECT year, month, units, revenue FROM monthly",
    "q4_stockout_risk": f"""SELECT product_id, demand_level, {_round("avg_daily_sales", 1)} AS avg_daily,
          {_round("avg_stock", 1)} AS avg_stock
        FROM product_clusters WHERE product_clusters.avg_stock < 2 * avg_daily_sales""",
    "q5_tier_rollup": f"""SELECT demand_level, COUNT(*) AS products,
          {_round("AVG(avg_daily_sales)", 2)} AS avg_daily_sales, {_money()} AS total_revenue
        FROM product_clusters GROUP BY demand_level""",
    "q6_weekend_split": f"""SELECT CASE WHEN d.weekday IN (5, 6) THEN 'weekend' ELSE 'weekday' END AS day_type,
          {_bigint("SUM(f.sales_qty)")} AS units, {_money("f.revenue")} AS revenue
        FROM fact_sales f JOIN dim_date d ON d.date_id = f.date_id GROUP BY 1""",
    "q7_store_in_warehouse": f"""SELECT s.warehouse_id, s.store_id, {_bigint("SUM(f.sales_qty)")} AS units,
          {_money("f.revenue")} AS revenue
        FROM fact_sales f JOIN dim_store s ON s.store_id = f.store_id GROUP BY 1, 2""",
    "api_sales_summary": "SELECT year, month, units, revenue FROM monthly",
    "api_warehouse_summary": "SELECT * FROM api_warehouse",
    "api_inventory_top": """SELECT product_id, demand_level, avg_daily_sales, avg_stock FROM product_clusters
        ORDER BY avg_daily_sales DESC, product_id LIMIT 50""",
    "api_tier_counts": "SELECT demand_level, COUNT(*) AS products FROM product_clusters GROUP BY 1",
    "run_query_suite": _suite_rows(),
    "scale_features": _z_scores(),
    # Promises of k-means and its labels, and how many rows there are to keep them.
    "kmeans_check": "SELECT COUNT(*) AS rows, 3::BIGINT AS clusters, "
    + ", ".join(f"0::BIGINT AS {c}" for c in ["unlabelled", "misplaced", "cheaper_seeds", "mixed_labels", "out_of_order"])
    + " FROM product_features",
    "demand_tier_labels": "SELECT product_id, avg_daily_sales, cluster, demand_level FROM product_clusters",
    "tier_sizes": "SELECT demand_level, COUNT(*) AS products FROM product_clusters GROUP BY 1",
    "tier_scatter": """SELECT product_id, product_name, demand_level, avg_daily_sales, revenue,
          printf('%s (%d)', demand_level, COUNT(*) OVER (PARTITION BY demand_level)) AS legend
        FROM product_clusters""",
    "scenario_baseline": "SELECT * FROM baseline",
    "scenario_baseline_by_warehouse": f"""SELECT warehouse_id, {_bigint("SUM(sales_qty)")} AS baseline_units,
          {_bigint("SUM(stock_qty)")} AS baseline_stock,
          COUNT(DISTINCT CASE WHEN c.demand_level = 'High' THEN f.product_id END) AS high_demand_products,
          'star_schema' AS baseline_from
        FROM fact_sales f JOIN (SELECT DISTINCT product_id, demand_level FROM product_clusters) c
          USING (product_id) GROUP BY warehouse_id""",
    "scenario_baseline_from_kpis": """SELECT total_units AS baseline_units, CAST(0 AS BIGINT) AS baseline_stock,
        CAST(0 AS BIGINT) AS high_demand_products, 'spark_kpis' AS baseline_from FROM kpis""",
    "scenario_forecast": "SELECT * FROM forecast",
    "scenario_forecast_festival": "SELECT * FROM forecast WHERE scenario = 'Festival'",
    "scenario_delta": f"""SELECT *, printf('%+.1f%%', delta_pct) AS delta_text FROM (
        SELECT *, {_round("(expected_units - baseline_units)::DOUBLE / baseline_units * 100", 1)} AS delta_pct
        FROM forecast)""",
    "headline_kpis": f"""SELECT {_money()} AS total_revenue, {_bigint("SUM(units)")} AS total_units,
          (SELECT COUNT(*) FROM dim_warehouse) AS warehouses, (SELECT COUNT(*) FROM dim_store) AS stores,
          (SELECT COUNT(*) FROM product_clusters WHERE demand_level = 'High') AS high_demand_products
        FROM monthly""",
    "tier_share": """SELECT t.demand_level, COUNT(c.demand_level) AS products,
          CAST(floor(100 * COUNT(c.demand_level)::DOUBLE / greatest(any_value(n), 1) + 0.5) AS BIGINT) AS share_pct
        FROM (VALUES ('Low'), ('Medium'), ('High')) t(demand_level)
        CROSS JOIN (SELECT COUNT(*) AS n FROM product_clusters)
        LEFT JOIN product_clusters c USING (demand_level) GROUP BY t.demand_level""",
    "warehouse_mini_stats": f"""SELECT
          (SELECT warehouse_id FROM api_warehouse ORDER BY units_sold DESC, warehouse_id LIMIT 1) AS top_warehouse_id,
          MAX(units_sold) AS top_units_sold,
          CAST(floor(AVG(avg_stock) + 0.5) AS BIGINT) AS avg_stock_per_warehouse, {_money()} AS total_revenue
        FROM api_warehouse""",
    "inventory_status": "SELECT * FROM inventory",
    "warehouse_velocity_risk": f"""SELECT *, CASE WHEN velocity_ratio < 0.8 THEN 'Understock'
          WHEN velocity_ratio > 1.4 THEN 'Overstock' ELSE 'Balanced' END AS velocity_risk
        FROM (SELECT *, {_round("avg_stock / greatest(units_sold / 1000::DOUBLE, 0.01::DOUBLE)", 2)} AS velocity_ratio
              FROM api_warehouse)""",
    "monthly_chart_series": "SELECT printf('%d-%02d', year, month) AS label, revenue, units FROM monthly",
    "run_batch": """SELECT (SELECT COUNT(*) FROM raw) AS raw_rows, transactions AS clean_rows, * FROM kpis""",
    "run_full": DIMENSION_COUNTS
    + " UNION ALL SELECT 'product_clusters', COUNT(*) FROM product_features"
    + " UNION ALL SELECT 'clean_sales', COUNT(*) FROM fact"
    + " UNION ALL SELECT 'units_by_warehouse', COUNT(*) FROM dim_warehouse"
    + " UNION ALL SELECT 'warehouse_summary', COUNT(*) FROM dim_warehouse"
    + " UNION ALL SELECT 'store_summary', COUNT(*) FROM (SELECT DISTINCT store_id, warehouse_id FROM fact)"
    + " UNION ALL SELECT 'product_features', COUNT(*) FROM product_features"
    + " UNION ALL SELECT 'time_summary', COUNT(*) FROM monthly"
    + " UNION ALL SELECT 'top_products', least(20, COUNT(*)) FROM product_features"
    + " UNION ALL SELECT 'dq_report', 1 UNION ALL SELECT 'dq_stages', 2 UNION ALL SELECT 'kpis', 1"
    + " UNION ALL SELECT 'scenario_forecast', COUNT(*) FROM forecast"
    + f" UNION ALL SELECT 'query_suite', COUNT(*) FROM ({_suite_rows()})",
}


def oracle_sql() -> dict[str, str]:
    dirty = {name: DIRTY_PREFIX + body for name, body in DIRTY_BODIES.items()}
    return {name: PREFIX + body for name, body in BODIES.items()} | dirty

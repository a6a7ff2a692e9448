"""Raw sales rows and demand tiers derived from the given star-schema tables.

A sale is a line item, a store is a supplier, a warehouse its nation. Those
tables have no stock column and no dirt, so both follow from the line's keys;
every line of the whole table takes part. ``dirty`` adds the kinds of dirt that the plain
rows lack: bad dates, null and NaN stock, negative and fractional quantities, null
prices, and rows that differ in their raw revenue or in a fraction only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.schema import RAW_COLUMNS

# avg_daily_sales below these is Low, Medium, else High.
LOW_BELOW, MEDIUM_BELOW = 24.0, 27.0


def _soiled(rows: DataFrame) -> DataFrame:
    """The joined lines, ``copies`` still to be exploded, with more dirt by their order key."""
    key = F.col("l_orderkey")

    def every(n: int, rest: int):
        return key % n == rest

    return rows.withColumns(
        {
            "date": F.when(every(110, 3), "not a date").when(every(130, 4), F.lit(None)).otherwise(F.col("date")),
            "product_name": F.when(~every(70, 5), F.col("product_name")),
            "sales_quantity": F.when(every(90, 6), -F.col("sales_quantity"))
            .when(every(100, 7), F.lit(float("nan")))
            .when(every(80, 8), F.lit(3e9))
            .when(every(20, 9), F.col("sales_quantity") + 0.75)
            .otherwise(F.col("sales_quantity")),
            "stock_quantity": F.when(every(120, 10), F.lit(None))
            .when(every(140, 11), F.lit(float("inf")))
            .when(every(30, 12), F.col("stock_quantity") + 0.25)
            .otherwise(F.col("stock_quantity")),
            "price": F.when(~every(150, 13), F.col("price")),
            "copies": F.when(every(40, 14), F.array(F.lit(3), F.lit(4), F.lit(4)))
            .when(every(40, 15), F.array(F.lit(5), F.lit(6)))
            .otherwise(F.col("copies")),
        }
    )


def _uneven_copies(rows: DataFrame) -> DataFrame:
    """Copies 3 and 4 differ in their raw revenue, 5 and 6 in a fraction of a unit."""
    copy = F.col("copy")
    return rows.withColumns(
        {
            "revenue": F.when(copy >= 3, copy * 1.0).otherwise(F.col("revenue")),
            "sales_quantity": F.when(copy == 6, F.col("sales_quantity") + 0.5).otherwise(F.col("sales_quantity")),
        }
    )


def raw_sales(spark: SparkSession, sf_dir: str, dirty: bool = False) -> DataFrame:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    lines = table("lineitem").select(
        "l_orderkey",
        F.col("l_shipdate").cast("date").cast("string").alias("date"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("store_id"),
        F.when(F.col("l_orderkey") % 300 != 0, F.col("l_quantity")).alias("sales_quantity"),
        F.when(F.col("l_orderkey") % 600 == 1, -5.0)
        .otherwise(
            20 + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13 + F.col("l_partkey") * 3) % 80
        )
        .cast("double")
        .alias("stock_quantity"),
        F.lit(None).cast("double").alias("revenue"),
        # Lines to appear twice: exploded after the joins, so each table is read once.
        F.when(F.col("l_orderkey") % 400 == 2, F.array(F.lit(1), F.lit(2)))
        .otherwise(F.array(F.lit(1)))
        .alias("copies"),
    )
    parts = table("part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_retailprice").alias("price"),
    )
    stores = table("supplier").select(
        F.col("s_suppkey").alias("store_id"), F.col("s_nationkey").alias("warehouse_id")
    )
    # No broadcast hints: Spark broadcasts a side by its measured size.
    joined = lines.join(parts, "product_id").join(stores, "store_id")
    if not dirty:
        return joined.select("*", F.explode("copies")).select(*RAW_COLUMNS)
    copies = _soiled(joined).select("*", F.explode("copies").alias("copy"))
    return _uneven_copies(copies).select(*RAW_COLUMNS)


def fixed_tiers(features: DataFrame) -> DataFrame:
    """Tiers by fixed cut points, standing in for k-means where results must be reproducible."""
    daily = F.col("avg_daily_sales")
    level = F.when(daily < LOW_BELOW, "Low").when(daily < MEDIUM_BELOW, "Medium").otherwise("High")
    # Cluster numbers are deliberately not in tier order.
    number = F.when(level == "Low", 2).when(level == "Medium", 0).otherwise(1)
    return features.select("*", number.alias("cluster"), level.alias("demand_level"))

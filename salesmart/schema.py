"""Column names and schemas shared by all operators.

The raw CSV keeps its published header; inside the library every column is
snake_case (``sources.readers.read_sales`` renames on the way in).
"""

from __future__ import annotations

from pyspark.sql import types as T

# Header and types of the raw sales file.
RAW_CSV_SCHEMA = T.StructType(
    [
        T.StructField("Date", T.StringType()),
        T.StructField("Product_ID", T.IntegerType()),
        T.StructField("Product_Name", T.StringType()),
        T.StructField("Store_ID", T.IntegerType()),
        T.StructField("Warehouse_ID", T.IntegerType()),
        T.StructField("Sales_Quantity", T.DoubleType()),
        T.StructField("Stock_Quantity", T.DoubleType()),
        T.StructField("Price", T.DoubleType()),
        T.StructField("Revenue", T.DoubleType()),
    ]
)

RAW_COLUMNS = [f.name.lower() for f in RAW_CSV_SCHEMA]

# A row is unusable when one of these is missing (the name and raw revenue may be null).
KEY_FIELDS = [
    "date",
    "product_id",
    "store_id",
    "warehouse_id",
    "sales_quantity",
    "stock_quantity",
    "price",
]

FACT_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("product_id", T.LongType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("store_id", T.LongType()),
        T.StructField("warehouse_id", T.IntegerType()),
        T.StructField("sales_quantity", T.IntegerType()),
        T.StructField("stock_quantity", T.IntegerType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("revenue", T.DoubleType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("month", T.IntegerType()),
        T.StructField("week", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("is_weekend", T.IntegerType()),
    ]
)

FACT_COLUMNS = FACT_SCHEMA.fieldNames()

# What identifies a clean sale; the other fact columns are computed from these.
SALE_COLUMNS = [*KEY_FIELDS, "product_name"]

# Inputs of the demand-tier model.
TIER_FEATURES = [
    "total_sales",
    "avg_daily_sales",
    "sales_volatility",
    "avg_stock",
    "revenue",
]

TIER_LABELS = ["Low", "Medium", "High"]

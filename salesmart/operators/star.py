"""Star schema over the cleaned fact: dimensions, fact projection, constraint checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.functions.dates import date_key
from salesmart.functions.rows import bit_of, word_of
from salesmart.operators.enrich import date_attributes

FACT_KEYS = {
    "date_id": "dim_date",
    "product_id": "dim_product",
    "store_id": "dim_store",
    "warehouse_id": "dim_warehouse",
}

PRIMARY_KEYS = {
    "dim_warehouse": "warehouse_id",
    "dim_store": "store_id",
    "dim_product": "product_id",
    "dim_date": "date_id",
}

TABLES = [*PRIMARY_KEYS, "fact_sales"]

NOT_NULL = {
    "dim_store": ["warehouse_id"],
    "dim_product": ["product_name", "price"],
    "dim_date": ["full_date", "year", "month", "day", "weekday"],
    "fact_sales": [
        "date_id",
        "product_id",
        "store_id",
        "warehouse_id",
        "sales_qty",
        "stock_qty",
        "revenue",
    ],
}


def dim_warehouse(fact: DataFrame) -> DataFrame:
    return fact.select("warehouse_id").distinct()


def dim_date(fact: DataFrame) -> DataFrame:
    return date_attributes(fact, "date")


def _first_attributes(fact: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """One row per key with the attributes seen on its earliest date.

    Two steps: the earliest date per distinct attribute set is a hash aggregate
    that shrinks the fact map-side; picking the smallest (date, attributes) needs
    a struct comparison and then only touches those few rows.
    """
    seen = fact.groupBy(key, *attributes).agg(F.min("date").alias("_since"))
    first = F.min(F.struct("_since", *attributes)).alias("_first")
    return seen.groupBy(key).agg(first).select(key, *(f"_first.{a}" for a in attributes))


def dim_store(fact: DataFrame) -> DataFrame:
    return _first_attributes(fact, "store_id", ["warehouse_id"])


def dim_product(fact: DataFrame) -> DataFrame:
    return _first_attributes(fact, "product_id", ["product_name", "price"])


def fact_sales(fact: DataFrame, with_sale_id: bool = False) -> DataFrame:
    """Fact projection. ``sale_id`` is unique, not dense, and only stable once written."""
    sales = fact.select(
        date_key(F.col("date")).alias("date_id"),
        "product_id",
        "store_id",
        "warehouse_id",
        F.col("sales_quantity").alias("sales_qty"),
        F.col("stock_quantity").alias("stock_qty"),
        "revenue",
    )
    if not with_sale_id:
        return sales
    return sales.select(F.monotonically_increasing_id().alias("sale_id"), "*")


def build_star(fact: DataFrame, with_sale_id: bool = False) -> dict[str, DataFrame]:
    return {
        "dim_warehouse": dim_warehouse(fact),
        "dim_store": dim_store(fact),
        "dim_product": dim_product(fact),
        "dim_date": dim_date(fact),
        "fact_sales": fact_sales(fact, with_sale_id),
    }


def star_row_counts(star: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        for t, df in star.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def _as_checks(one_row: DataFrame, table: str, checks: list[tuple[str, str]]) -> DataFrame:
    """Violation counts, one column per (check, column), turned into one row each."""
    entries = F.array(
        *(
            F.struct(
                F.lit(table).alias("table_name"),
                F.lit(check).alias("check_type"),
                F.lit(column).alias("column_name"),
                F.coalesce(F.col(f"{check}:{column}"), F.lit(0)).cast("bigint").alias("violations"),
            )
            for check, column in checks
        )
    )
    return one_row.select(F.inline(entries))


def _column_checks(df: DataFrame, table: str, key: str | None, required: list[str]) -> DataFrame:
    """Unique key and required columns of one table, in one pass.

    Keys are whole numbers. They are marked in bitmaps of 64 numbers each, so that
    what is shuffled is one row per 64 neighbours, whatever the number of rows; the
    bits that are set are the distinct keys. Null keys violate uniqueness.
    """
    checks = [("not_null", c) for c in required]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"not_null:{c}") for c in required]
    if key is None:
        return _as_checks(df.agg(*nulls), table, checks)
    checks.insert(0, ("unique", key))
    words = df.groupBy(word_of(F.col(key)).alias("_word")).agg(
        F.count(F.lit(1)).alias("_rows"), F.bit_or(bit_of(F.col(key))).alias("_bits"), *nulls
    )
    distinct = F.coalesce(F.sum(F.bit_count("_bits")), F.lit(0))
    totals = words.agg(
        (F.sum("_rows") - distinct).alias(f"unique:{key}"),
        *(F.sum(f"not_null:{c}").alias(f"not_null:{c}") for c in required),
    )
    return _as_checks(totals, table, checks)


def _foreign_key_check(
    df: DataFrame, table: str, references: dict[str, DataFrame]
) -> DataFrame:
    """Rows per foreign key whose value is absent from its dimension.

    All keys go through one scan: unpivoted to (column, value) and counted
    map-side, so what is shuffled and joined is one row per distinct key value,
    however hot the key.
    """
    wide = df.select(*(F.col(c).cast("bigint").alias(c) for c in references))
    used = (
        wide.unpivot([], list(references), "_column", "_value")
        .filter(F.col("_value").isNotNull())
        .groupBy("_column", "_value")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    known = reduce(
        DataFrame.unionByName,
        (
            dim.select(
                F.lit(c).alias("_column"),
                F.col(PRIMARY_KEYS[FACT_KEYS[c]]).cast("bigint").alias("_value"),
            )
            for c, dim in references.items()
        ),
    )
    orphans = used.join(known, ["_column", "_value"], "left_anti")
    missing = [
        F.sum(F.when(F.col("_column") == c, F.col("_rows"))).alias(f"foreign_key:{c}")
        for c in references
    ]
    return _as_checks(orphans.agg(*missing), table, [("foreign_key", c) for c in references])


def attribute_conflicts(fact: DataFrame, table: str, key: str, attributes: list[str]) -> DataFrame:
    """Number of keys that occur with more than one set of attributes."""
    sets = fact.select(key, *attributes).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_sets"))
    conflicts = sets.agg(F.count_if(F.col("_sets") > 1).alias(f"conflict:{key}"))
    return _as_checks(conflicts, table, [("conflict", key)])


def star_integrity(star: dict[str, DataFrame], fact: DataFrame | None = None) -> DataFrame:
    """The declared constraints as data: one row per check with its violations.

    Meant for written star tables. With ``fact`` (the frame the star was built
    from) also reports keys whose attributes contradict each other, which the
    dimensions had to decide.
    """
    checks = [
        _column_checks(star[t], t, key, NOT_NULL.get(t, [])) for t, key in PRIMARY_KEYS.items()
    ]
    sales = star["fact_sales"]
    numbered = "sale_id" if "sale_id" in sales.columns else None
    checks.append(_column_checks(sales, "fact_sales", numbered, NOT_NULL["fact_sales"]))
    checks.append(
        _foreign_key_check(star["dim_store"], "dim_store", {"warehouse_id": star["dim_warehouse"]})
    )
    checks.append(
        _foreign_key_check(sales, "fact_sales", {c: star[t] for c, t in FACT_KEYS.items()})
    )
    if fact is not None:
        checks.append(attribute_conflicts(fact, "dim_store", "store_id", ["warehouse_id"]))
        checks.append(
            attribute_conflicts(fact, "dim_product", "product_id", ["product_name", "price"])
        )
    return reduce(DataFrame.unionByName, checks)

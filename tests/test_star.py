from pyspark.sql import functions as F

from salesmart.operators import star


def _violations(checks):
    return {
        (r.table_name, r.check_type, r.column_name): r.violations
        for r in checks.filter("violations > 0").collect()
    }


def test_first_attributes_win_and_conflicts_show(fact_of):
    fact = fact_of(
        {"date": "2026-06-08", "warehouse_id": 1, "price": 5.0},
        {"date": "2026-06-07", "warehouse_id": 2, "price": 9.0},
        {"date": "2026-06-07", "warehouse_id": 2, "price": 7.0},
    )
    assert star.dim_store(fact).collect() == [(1, 2)]
    assert star.dim_product(fact).collect() == [(1, "Product_1", 7.0)]
    assert _violations(star.star_integrity(star.build_star(fact), fact)) == {
        ("dim_store", "conflict", "store_id"): 1,
        ("dim_product", "conflict", "product_id"): 1,
    }


def test_broken_constraints_are_counted(fact_of):
    fact = fact_of({}, {"product_id": 2}, {"product_id": 2, "store_id": 3, "warehouse_id": 4})
    tables = star.build_star(fact)
    tables["dim_product"] = tables["dim_product"].filter("product_id = 1").withColumn(
        "product_name", F.lit(None).cast("string")
    )
    tables["dim_warehouse"] = tables["dim_warehouse"].filter("warehouse_id = 1").unionByName(
        tables["dim_warehouse"].filter("warehouse_id = 1")
    )
    assert _violations(star.star_integrity(tables)) == {
        ("dim_product", "not_null", "product_name"): 1,
        ("dim_warehouse", "unique", "warehouse_id"): 1,
        ("dim_store", "foreign_key", "warehouse_id"): 1,
        ("fact_sales", "foreign_key", "product_id"): 2,
        ("fact_sales", "foreign_key", "warehouse_id"): 1,
    }


def test_date_dimension(fact_of):
    fact = fact_of({"date": "2026-06-06"}, {"date": "2026-06-07"}, {"date": "2026-06-08"}, {"date": "2026-06-08", "store_id": 2})
    rows = star.dim_date(fact).orderBy("date_id").collect()
    assert [(r.date_id, r.full_date, r.weekday) for r in rows] == [
        (20260606, "2026-06-06", 5),
        (20260607, "2026-06-07", 6),
        (20260608, "2026-06-08", 0),
    ]


def test_sale_ids_are_unique(fact_of):
    sales = star.fact_sales(fact_of(*({"product_id": i} for i in range(30))), with_sale_id=True)
    ids = [r.sale_id for r in sales.collect()]
    assert len(set(ids)) == 30


def test_repeated_and_missing_sale_ids_are_counted(spark, fact_of):
    tables = star.build_star(fact_of(*({"product_id": i} for i in range(200))), with_sale_id=True)
    numbered = tables["fact_sales"].withColumn("sale_id", F.col("product_id").cast("bigint"))
    for sale_id, violations in ((F.col("sale_id"), 0), (F.col("sale_id") % 150, 50), (F.lit(-1), 199), (F.lit(None).cast("bigint"), 200)):
        tables["fact_sales"] = numbered.withColumn("sale_id", sale_id)
        found = _violations(star.star_integrity(tables)).get(("fact_sales", "unique", "sale_id"), 0)
        assert found == violations

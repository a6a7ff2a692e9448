import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from salesmart.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


RAW_TYPES = (
    "date string, product_id int, product_name string, store_id int, warehouse_id int,"
    " sales_quantity double, stock_quantity double, price double, revenue double"
)


@pytest.fixture
def raw_of(spark):
    """Raw sales frame from partial rows; unset fields get plain values."""
    names = [c.split()[0] for c in RAW_TYPES.split(", ")]
    plain = dict(zip(names, ["2026-06-06", 1, "Product_1", 1, 1, 2.0, 50.0, 10.0, None]))

    def build(*rows: dict):
        data = [tuple({**plain, **r}[n] for n in names) for r in rows]
        return spark.createDataFrame(data, RAW_TYPES)

    return build


@pytest.fixture
def fact_of(raw_of):
    from salesmart.operators.enrich import enrich_sales
    from salesmart.operators.quality import clean_sales

    return lambda *rows: enrich_sales(clean_sales(raw_of(*rows)))

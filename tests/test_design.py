"""Plans and sources keep to the distributed design."""

import pathlib
import re

import pytest

import __spark_entry__ as entry_module
from salesmart.session import shuffle_settings

PACKAGE = pathlib.Path(entry_module.__file__).parent / "salesmart"
SF_DIR = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_rows_through_the_driver():
    for path in PACKAGE.rglob("*.py"):
        if "llm" in path.relative_to(PACKAGE).parts:
            continue  # its operators bound what they collect, and say by what
        text = path.read_text()
        for call in (".collect()", ".toPandas()", ".toLocalIterator(", "localCheckpoint", ".crossJoin(", ".rdd"):
            assert call not in text, f"{path}: {call}"


@pytest.mark.parametrize("name", ["warehouse_summary", "top_products", "scenario_forecast", "q2_top_products_by_name", "tier_scatter"])
def test_no_cross_products(spark, name):
    plan = _plan(entry_module.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scan_is_pruned_and_filtered(spark):
    plan = _plan(entry_module.queries()["clean_sales"](spark, SF_DIR))
    scan = next(s for s in plan.split("FileScan")[1:] if "l_orderkey" in s)
    assert "l_extendedprice" not in scan.split("ReadSchema")[1]
    assert re.search(r"PushedFilters: \[[^\]]*IsNotNull", scan)


def test_top_k_limits_before_ranking(spark):
    plan = _plan(entry_module.queries()["top_products"](spark, SF_DIR))
    assert "TakeOrderedAndProject" in plan
    # No sort of all products; the one range exchange orders the n result rows.
    assert plan.count("rangepartitioning") <= 1


@pytest.mark.parametrize("name", ["q2_top_products_by_name", "api_inventory_top"])
def test_sql_top_k_needs_no_global_sort(spark, name):
    plan = _plan(entry_module.queries()[name](spark, SF_DIR))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_shuffle_settings_follow_the_input():
    hundred_tb = shuffle_settings(100 * 2**40)
    assert int(hundred_tb["spark.sql.shuffle.partitions"]) == 100 * 2**12
    assert int(hundred_tb["spark.sql.files.maxPartitionBytes"]) == 2**28
    limited = shuffle_settings(100 * 2**40, max_partitions=50_000)
    assert int(limited["spark.sql.shuffle.partitions"]) == 50_000
    assert int(limited["spark.sql.files.maxPartitionBytes"]) == -(-100 * 2**40 // 50_000)
    assert int(shuffle_settings(2**40)["spark.sql.shuffle.partitions"]) == 4096
    assert int(shuffle_settings(1)["spark.sql.shuffle.partitions"]) == 8

import json
import os

import pytest
from pyspark.sql import functions as F

from salesmart.operators import quality, summaries
from salesmart.operators.quality import corrupt_rows
from salesmart.schema import RAW_COLUMNS
from salesmart.sources import readers, tables

HEADER = "Date,Product_ID,Product_Name,Store_ID,Warehouse_ID,Sales_Quantity,Stock_Quantity,Price,Revenue"
GOOD = "2026-06-06,1,Product_1,2,3,4.0,50,9.99,39.96"


@pytest.fixture
def csv_file(tmp_path):
    def write(*lines, header=HEADER):
        path = tmp_path / "sales.csv"
        path.write_text("\n".join([header, *lines]) + "\n")
        return str(path)

    return write


def test_reads_typed_snake_case(spark, csv_file):
    df = readers.read_sales(spark, csv_file(GOOD))
    assert df.columns == RAW_COLUMNS
    assert df.first().asDict()["price"] == 9.99


def test_swapped_header_fails(spark, csv_file):
    swapped = HEADER.replace("Store_ID,Warehouse_ID", "Warehouse_ID,Store_ID")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_sales(spark, csv_file(GOOD, header=swapped)).collect()


def test_bad_and_extra_cells_are_kept_as_corrupt(spark, csv_file):
    path = csv_file(GOOD, GOOD.replace("9.99", "cheap"), GOOD + ",more")
    rows = readers.read_sales(spark, path, keep_corrupt=True).cache()
    assert rows.filter("price is null").count() == 1
    assert corrupt_rows(rows).count() == 2
    # The corrupt text is no part of the row when copies are dropped.
    assert quality.clean_sales(rows).count() == 1


def test_load_processed_prefers_then_falls_back(spark, tmp_path, fact_of):
    fact = fact_of({}, {"product_id": 2})
    first, second = str(tmp_path / "first"), str(tmp_path / "second")
    with pytest.raises(FileNotFoundError):
        readers.load_processed(spark, [first, second], fact.schema)
    tables.write_table(fact, second)
    assert readers.load_processed(spark, [first, second], fact.schema).count() == 2
    tables.write_table(fact.limit(1), first)
    assert readers.load_processed(spark, [first, second], fact.schema).count() == 1


def test_replace_and_append(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(5), path)
    tables.replace_table(spark.range(3), path)
    assert tables.append_table(spark.range(2), path).count() == 5


def test_report_json(spark, tmp_path, raw_of, fact_of):
    raw = raw_of({}, {}, {"sales_quantity": None})
    path = str(tmp_path / "report")
    tables.write_report_json(quality.dq_report(raw), summaries.kpi_snapshot(fact_of({})), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    document = json.loads(lines[0])
    assert len(lines) == 1
    assert [d["stage"] for d in document["dq"]] == ["before_clean", "after_clean"]
    assert document["dq"][1]["rows_removed"] == 2
    assert "rows_removed" not in document["dq"][0]
    assert document["kpis"]["total_revenue"] == 20.0


def test_scratch_is_fresh_and_follows_the_shared_setting(spark):
    one, two = tables.scratch_dir(spark, "x"), tables.scratch_dir(spark, "x")
    assert one != two
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        assert one.startswith(shared)


class _Session:
    """Just the settings a session would have."""

    def __init__(self, **settings):
        named = {k.replace("_", "."): v for k, v in settings.items()}
        self.conf = type("Conf", (), {"get": staticmethod(lambda k, default=None: named.get(k, default))})


def test_scratch_without_the_shared_setting():
    assert os.path.isdir(tables.scratch_dir(_Session(spark_master="local[8]"), "x"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        tables.scratch_dir(_Session(spark_master="yarn"), "x")
    shared = _Session(spark_master="yarn", spark_checkpoint_dir="hdfs:///shared/")
    assert tables.scratch_dir(shared, "x").startswith("hdfs:///shared/salesmart/x-")


def test_write_table_returns_what_was_written(spark, tmp_path):
    df = spark.range(4).select("id", F.lit("a,b\"c").alias("text"))
    for file_format in ("parquet", "csv", "json"):
        back = tables.write_table(df, str(tmp_path / file_format), file_format)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def _failing(spark):
    """Two partitions, of which the second can't be written."""
    return spark.range(0, 10, 1, 2).select(F.when(F.col("id") < 7, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).alias("id"))


def _ids(df):
    return sorted(r.id for r in df.collect())


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(3), path)
    for write in (tables.replace_table, tables.write_table, lambda df, p: tables.append_table(df, p, "r1")):
        with pytest.raises(Exception, match="broken"):
            write(_failing(spark), path)
        assert _ids(spark.read.parquet(path)) == [0, 1, 2]
    assert os.listdir(tmp_path) == ["t"]


def test_a_table_may_be_replaced_by_rows_of_its_own(spark, tmp_path):
    path = str(tmp_path / "t")
    old = tables.replace_table(spark.range(10), path)
    assert _ids(tables.replace_table(old.where("id > 6"), path)) == [7, 8, 9]


def test_a_replacement_cut_off_between_its_moves_is_recovered(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(3), path)
    os.rename(path, f"{path}.replaced")
    tables.recover_table(spark, path)
    assert _ids(spark.read.parquet(path)) == [0, 1, 2]
    os.rename(path, f"{path}.replaced")
    assert _ids(tables.append_table(spark.range(3, 4), path, "late")) == [0, 1, 2, 3]


def test_a_repeated_append_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_table(spark.range(3), path)
    tables.append_table(spark.range(3, 5, 1, 2), path, "monday")
    tables.append_table(spark.range(3, 5), path, "monday")
    assert _ids(tables.append_table(spark.range(5, 6), path, "tuesday")) == [0, 1, 2, 3, 4, 5]
    # What an attempt that did not finish left behind goes.
    os.remove(f"{path}/_runs/tuesday")
    assert _ids(tables.append_table(spark.range(7, 9), path, "tuesday")) == [0, 1, 2, 3, 4, 7, 8]
    with pytest.raises(ValueError, match="run id"):
        tables.append_table(spark.range(1), path, "../x")


LEAVES_NOTHING = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", "{folder}").config("spark.ui.enabled", "false").getOrCreate()
print(e.queries()["sink_table"](spark, "/root/testdata/sf0.001").count())
"""


def test_scratch_goes_with_the_driver(tmp_path):
    import subprocess
    import sys

    run = subprocess.run([sys.executable, "-c", LEAVES_NOTHING.format(folder=tmp_path)], capture_output=True, text=True)
    assert run.returncode == 0 and int(run.stdout.split()[-1]) > 0, run.stderr
    assert [f for _, _, files in os.walk(tmp_path) for f in files] == []

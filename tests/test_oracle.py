"""Every registered query against its SQL twin on the smallest test tables."""

import os
import re

import pytest

import __spark_entry__ as entry_module
from compare import differences, duckdb_tables

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = {q: f for q, f in entry_module.queries().items() if not re.match(r"op\d+_|pipeline$", q)}
ORACLE = entry_module.oracle_sql()
WITHOUT_SQL = {"kmeans_clusters", "demand_tiers"}


@pytest.fixture(scope="module")
def con():
    return duckdb_tables(SF_DIR)


def test_every_query_has_sql_except_kmeans():
    assert set(QUERIES) - set(ORACLE) == WITHOUT_SQL
    assert set(ORACLE) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(set(ORACLE) & set(QUERIES)))
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) == []


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0

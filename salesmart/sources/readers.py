"""Typed readers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from salesmart.operators.enrich import snake_case_columns
from salesmart.operators.quality import CORRUPT
from salesmart.schema import FACT_SCHEMA, RAW_CSV_SCHEMA


def read_sales(spark: SparkSession, path: str, keep_corrupt: bool = False) -> DataFrame:
    """The raw sales CSV with its fixed schema, column names in snake_case.

    The header must name the columns in schema order; a reordered file fails
    instead of loading values into the wrong columns. A bad cell is null;
    ``keep_corrupt`` also keeps the text of such rows in ``_corrupt_record``.
    """
    schema = T.StructType(list(RAW_CSV_SCHEMA))
    if keep_corrupt:
        schema = schema.add(CORRUPT, T.StringType())
    return snake_case_columns(
        spark.read.csv(
            path,
            header=True,
            schema=schema,
            enforceSchema=False,
            mode="PERMISSIVE",
            columnNameOfCorruptRecord=CORRUPT,
        )
    )


def load_processed(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType = FACT_SCHEMA,
    file_format: str = "parquet",
) -> DataFrame:
    """A processed table from the first of ``paths`` that exists, with its fixed schema."""
    options = {"header": True, "enforceSchema": False} if file_format == "csv" else {}
    for path in paths:
        try:
            return spark.read.format(file_format).schema(schema).options(**options).load(path)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of these exists: {list(paths)}")

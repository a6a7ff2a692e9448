"""Order-insensitive comparison of a Spark result with its DuckDB twin."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def duckdb_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, "" if v is None else str(v)) for v in row)


def differences(df, con, sql: str) -> list[str]:
    """Empty when rows, column names, types and values agree exactly."""
    names = sorted(df.columns)
    left = df.select(*names)
    right = con.execute(f"SELECT {', '.join(names)} FROM ({sql})")
    found = []
    all_names = sorted(d[0] for d in con.execute(sql).description)
    if names != all_names:
        return [f"columns {names} != {all_names}"]
    right = con.execute(f"SELECT {', '.join(names)} FROM ({sql})")
    right_types = [str(d[1]) for d in right.description]
    left_types = [TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in left.schema]
    if left_types != right_types:
        found.append(f"types {list(zip(names, left_types, right_types))}")
    ours = sorted((tuple(r) for r in left.collect()), key=_key)
    theirs = sorted(right.fetchall(), key=_key)
    if len(ours) != len(theirs):
        return found + [f"row count {len(ours)} != {len(theirs)}"]
    for a, b in zip(ours, theirs):
        same = all(
            x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
            for x, y in zip(a, b)
        )
        if not same:
            found.append(f"{dict(zip(names, a))} != {dict(zip(names, b))}")
            if len(found) > 3:
                break
    return found

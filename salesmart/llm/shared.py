"""Folders and files that the driver and all executors share."""

from __future__ import annotations

import atexit
import posixpath
import re
import shutil
import tempfile
import uuid
from functools import lru_cache
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which a cluster has to name.

    A local session without that setting, as in tests, gets a folder that goes
    when its process ends. The tables in a named folder belong to the query that
    asked for it; whoever owns the checkpoint folder empties it, as with Spark's
    own checkpoints.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _process_folder()


@lru_cache(maxsize=1)
def _process_folder() -> str:
    folder = tempfile.mkdtemp(prefix="salesmart-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def written(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back: what follows has no lineage beyond the files."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` and more fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def file_system(uri: str):
    """The Arrow file system and path of ``uri``; a path without a scheme is a local one."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_whole(uri: str, parts: list) -> None:
    """Writes a file that appears whole or not at all, also if several attempts write it."""
    files, path = file_system(uri)
    files.create_dir(posixpath.dirname(path), recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.attempt"
    with files.open_output_stream(attempt) as out:
        for part in parts:
            out.write(part)
    files.move(attempt, path)


def read_whole(uri: str) -> bytes:
    files, path = file_system(uri)
    with files.open_input_file(path) as source:
        return source.read()

"""Sinks. All rows are written by the executors, never through the driver.

Tables are replaced and extended through Hadoop's file system interface: rows are
written beside the table first and moved into place when they are complete. Moving
is a rename, so on a store without renames (most object stores) a replacement is
safe but not instantaneous.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._=-]*")


class _Folder:
    """A path and the file system that holds it."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = path.rstrip("/")
        self.system = self._path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def __getattr__(self, name: str):
        return getattr(self.system, name)

    def at(self, path: str):
        return self._path(path)

    def has(self, path: str) -> bool:
        return self.system.exists(self.at(path))

    def remove(self, path: str) -> None:
        self.system.delete(self.at(path), True)

    def move(self, path: str, to: str) -> None:
        if not self.system.rename(self.at(path), self.at(to)):
            raise OSError(f"could not move {path} to {to}")

    def files(self, path: str) -> list[str]:
        """Names of the data files in a folder."""
        if not self.has(path):
            return []
        names = (s.getPath().getName() for s in self.system.listStatus(self.at(path)))
        return sorted(n for n in names if not n.startswith(("_", ".")))


def _options(file_format: str) -> dict:
    return {"header": True} if file_format == "csv" else {}


def _read_back(df: DataFrame, path: str, file_format: str) -> DataFrame:
    back = df.sparkSession.read.format(file_format).schema(df.schema).options(**_options(file_format))
    return back.load(path)


def write_table(
    df: DataFrame, path: str, file_format: str = "parquet", mode: str = "overwrite"
) -> DataFrame:
    """Writes ``df`` and returns a frame that reads it back from ``path``.

    With ``overwrite`` the table that is there stays readable until the new one is complete.
    """
    if mode == "overwrite":
        return replace_table(df, path, file_format)
    df.write.mode(mode).format(file_format).options(**_options(file_format)).save(path)
    return _read_back(df, path, file_format)


def recover_table(spark: SparkSession, path: str) -> None:
    """Puts the old table back where a replacement was cut off between its two moves."""
    folder = _Folder(spark, path)
    if not folder.has(folder.root) and folder.has(f"{folder.root}.replaced"):
        folder.move(f"{folder.root}.replaced", folder.root)


def replace_table(df: DataFrame, path: str, file_format: str = "parquet") -> DataFrame:
    """Replaces the table at ``path``, from which ``df`` may read.

    The new table is written beside the old one and then takes its place. A write that
    fails leaves the old table as it was and nothing beside it.
    """
    spark = df.sparkSession
    folder = _Folder(spark, path)
    recover_table(spark, path)
    root, staged, old = folder.root, f"{folder.root}.{uuid.uuid4().hex}.staged", f"{folder.root}.replaced"
    try:
        df.write.format(file_format).options(**_options(file_format)).save(staged)
    except BaseException:
        folder.remove(staged)
        raise
    folder.remove(old)
    if folder.has(root):
        folder.move(root, old)
    folder.mkdirs(folder.at(root).getParent())
    folder.move(staged, root)
    folder.remove(old)
    return _read_back(df, path, file_format)


def append_table(df: DataFrame, path: str, run_id: str | None = None, file_format: str = "parquet") -> DataFrame:
    """Appends to the table at ``path``.

    With a ``run_id`` (letters, digits, ``.``, ``_``, ``=``, ``-``) an append happens once:
    what a failed attempt of the run left is removed, and a run that was completed
    before adds nothing. Its files carry its name; a reader may see some of them before
    the last. Two runs of one name must not append at the same time.
    """
    if run_id is None:
        return write_table(df, path, file_format, mode="append")
    if not RUN_ID.fullmatch(run_id):
        raise ValueError(f"not a run id: {run_id!r}")
    spark = df.sparkSession
    folder = _Folder(spark, path)
    recover_table(spark, path)
    done, staged = f"{folder.root}/_runs/{run_id}", f"{folder.root}/_staged-{run_id}"
    if not folder.has(done):
        df.write.mode("overwrite").format(file_format).options(**_options(file_format)).save(staged)
        mine = f"run-{run_id}-part-"
        for name in folder.files(folder.root):
            if name.startswith(mine):
                folder.remove(f"{folder.root}/{name}")
        for number, name in enumerate(folder.files(staged)):
            ending = name[name.index(".") :] if "." in name else ""
            folder.move(f"{staged}/{name}", f"{folder.root}/{mine}{number:05d}{ending}")
        folder.mkdirs(folder.at(f"{folder.root}/_runs"))
        folder.create(folder.at(done)).close()
        folder.remove(staged)
    return _read_back(df, path, file_format)


def report_document(dq: DataFrame, kpis: DataFrame) -> DataFrame:
    """One row ``{dq: [...], kpis: {...}}``. ``dq`` is the two-row report, ``kpis`` one row."""
    position = F.when(F.col("stage") == "before_clean", 0).otherwise(1)
    entries = F.sort_array(F.collect_list(F.struct(position.alias("at"), F.struct(*dq.columns).alias("row"))))
    stages = dq.agg(F.transform(entries, lambda e: e["row"]).alias("dq")).scalar()
    return kpis.select(stages.alias("dq"), F.struct(*kpis.columns).alias("kpis"))


def write_report_json(dq: DataFrame, kpis: DataFrame, path: str) -> DataFrame:
    return write_table(report_document(dq, kpis), path, "json")


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for intermediate tables, under the shared ``spark.checkpoint.dir``.

    It goes when the driver ends. Only a local session without that setting falls back
    to a temporary folder; on a cluster such a folder would not be shared.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        folder = f"{shared.rstrip('/')}/salesmart/{purpose}-{uuid.uuid4().hex}"
        if getattr(spark, "_jvm", None) is not None:
            owned = _Folder(spark, folder)
            owned.mkdirs(owned.at(folder))
            owned.deleteOnExit(owned.at(folder))
        return folder
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix=f"salesmart-{purpose}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder

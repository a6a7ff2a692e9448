"""Session settings."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

MIB = 1024 * 1024

T = TypeVar("T")


def shuffle_settings(
    input_bytes: int, partition_bytes: int = 256 * MIB, max_partitions: int | None = None
) -> dict[str, str]:
    """Settings that size scans and shuffles to the input.

    The distinct over all raw columns moves every usable row once, so its
    partition count has to follow the input. AQE merges what turns out small and
    splits skewed join partitions, but cannot split an aggregate's partitions;
    the initial number therefore errs on the high side. A shuffle has to track maps
    times reducers; who limits their number with ``max_partitions`` gets reducers
    and scan splits of the larger size that follows from it.
    """
    wanted = max(8, -(-input_bytes // partition_bytes))
    partitions = wanted if max_partitions is None else min(wanted, max_partitions)
    split = max(partition_bytes, -(-input_bytes // partitions))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(split),
    }


def apply_settings(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    for key, value in settings.items():
        spark.conf.set(key, value)
    return spark


def concurrently(
    spark: SparkSession, jobs: dict[str, Callable[[], T]], parallelism: int = 4
) -> dict[str, T]:
    """Results of independent Spark jobs submitted from a few threads.

    The tail of one job then overlaps the next; the first error is raised.
    """
    run = inheritable_thread_target(spark)(lambda job: job())
    with ThreadPool(min(parallelism, max(1, len(jobs)))) as pool:
        return dict(zip(jobs, pool.map(run, jobs.values(), chunksize=1)))


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark: the settings of a small input, and no web page."""
    settings = shuffle_settings(input_bytes=0) | {
        "spark.app.name": "salesmart",
        "spark.master": f"local[{cpus}]",
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

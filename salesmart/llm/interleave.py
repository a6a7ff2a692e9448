"""Proportional stratified interleaving: every shard gets the mixture of the whole.

Rows are shuffled by a seeded hash and ranked within their source; the fractional
rank (rank - 1/2) / rows of the source spreads each source evenly over [0, 1).
Sorted by it, any run of rows holds the sources in proportion, so the sorted rows
are cut into shards of equal row counts.

Ranks are counted in buckets, so that no task sorts a source or the whole table:
the shuffle hash, and then the fractional rank, is cut into about four times the
square root of the row count, and a row's rank is the number of rows in lower
buckets plus its place in its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesmart.llm.shared import written

HASH_BITS = 40


def seeded_order(seed: int, *columns: str) -> Column:
    """A number below 2**HASH_BITS that shuffles rows in the same way at every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 64 - HASH_BITS)


def _ranked(rows: DataFrame, by: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """Adds the 1-based rank in ``order`` among the rows with equal ``by``; buckets follow the order."""
    counts = rows.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("_n"))
    lower = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, bucket, F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, bucket).orderBy(*order)
    placed = rows.withColumn("_place", F.row_number().over(inside))
    same = [*by, bucket]
    on = [placed[c].eqNullSafe(starts[c]) for c in same]
    joined = placed.join(starts, on, "left").drop(*(starts[c] for c in same))
    return joined.withColumn(name, F.col("_before") + F.col("_place")).drop("_before", "_place")


def interleave(
    docs: DataFrame,
    folder: str,
    shards: int = 16,
    seed: int = 17,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per document: ``key, size, text_crc32, source, shard, slot``.

    Shards run from 0, their row counts differ by one at most, and slots in a
    shard have no gap. A null source is a source of its own, null texts have no
    bytes. Rows that agree in key and text are told apart by nothing else, so
    either may take either place; rows with a null key are placed like others.
    Narrow rows are written below ``folder`` between the two rankings, texts are not.
    """
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.col(source).cast("string").alias("source"),
    ).withColumn("_hash", seeded_order(seed, "doc_id", "text_crc32", "size"))
    narrow = written(narrow, f"{folder}/narrow")
    total = narrow.count()
    buckets = max(1, math.ceil(4 * math.sqrt(total)))
    width = max(1, (1 << HASH_BITS) // buckets)
    dealt = narrow.withColumn("_bucket", F.expr(f"_hash div {width}"))
    order = ["_hash", "doc_id", "text_crc32", "size"]
    ranked = _ranked(dealt, ["source"], "_bucket", order, "_rank")
    counts = narrow.groupBy("source").agg(F.count(F.lit(1)).alias("_rows"))
    fraction = (F.col("_rank") - F.lit(0.5)) / F.col("_rows")
    spread = ranked.join(counts, ranked["source"].eqNullSafe(counts["source"])).select(
        ranked["doc_id"], "size", "text_crc32", ranked["source"], "_hash", fraction.alias("_fraction")
    )
    spread = written(
        spread.withColumn("_bucket", F.floor(F.col("_fraction") * buckets)), f"{folder}/spread"
    )
    order = ["_fraction", "source", "_hash", "doc_id", "text_crc32", "size"]
    placed = _ranked(spread.withColumn("_all", F.lit(0)), ["_all"], "_bucket", order, "_rank")
    at = F.col("_rank") - 1
    rows = F.lit(max(1, total)).cast("bigint")
    # Shard i takes the places from ceil(i * rows / shards) on.
    shard = F.expr(f"cast(((_rank - 1) * {shards}) div {max(1, total)} as int)")
    begin = F.ceil(F.col("shard").cast("bigint") * rows / F.lit(shards))
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", "source", "shard", (at - begin).cast("bigint").alias("slot")
    )


def write_interleaved(docs: DataFrame, assignment: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes the rows of ``docs``, whose keys are distinct, as one folder per shard in slot order."""
    placed = docs.join(assignment.select(F.col(key), "shard", "slot"), key)
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

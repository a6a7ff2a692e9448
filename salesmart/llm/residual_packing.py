"""Best-fit packing of documents into sequences, level by level.

Documents become pieces of at most ``capacity`` tokens. Each partition packs its
pieces best fit, longest first, and emits the bins that are nearly full. The bins
left underfull go on as items of their own: groups of partitions form a tree, and
at each of its levels a group packs the underfull bins of its members again. Only
lengths travel; a bin that was packed into another is a shift of its pieces.

Best fit leaves one bin at most that is half full or less, and two fuller ones do not
fit into one. So a group of later levels has one bin of each member to place, and of
bins that are equally full no more than one for each of those can be of use. The others are
emitted, which bounds what is handed on and changes no result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.shared import written
from salesmart.llm.token_index import with_end
from salesmart.llm.tokens import text_encoder

CAPACITY = 2048
#: Share of the capacity from which a bin counts as nearly full.
NEARLY_FULL = 0.995
#: Partitions or groups that one group of the next level merges.
FAN_IN = 8
#: A bin's number is its partition's times this plus its place there.
BINS_PER_PARTITION = 1 << 33

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_lengths(n_tokens: int, capacity: int) -> list[int]:
    """Whole pieces from the end; what remains comes first."""
    first = n_tokens % capacity
    return ([first] if first else []) + [capacity] * (n_tokens // capacity)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document's ids with the end id; null texts are empty.

    Each row is a document, also one with a null doc_id or one that others have, too.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer)
        for batch in batches:
            ids, bounds = with_end(*encoder(batch.column("text")))
            wide = ids.astype("<u4")
            lengths = [cut_lengths(int(n), capacity) for n in np.diff(bounds)]
            counts = np.array([len(own) for own in lengths], np.int64)
            length = np.array([n for own in lengths for n in own], np.int64)
            rows = np.repeat(np.arange(len(counts)), counts)
            place = np.concatenate([[0], np.cumsum(length)])
            raw = memoryview(wide.tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(place[:-1], place[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)),
                 pa.array((np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)),
                 pa.array(place[:-1] - np.asarray(bounds)[rows]), pa.array(length), pa.array(sums, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(cut, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each item, longest items first, each where least room is left.

    Bins are kept by their room; a bit mask of the rooms in use finds the smallest
    that suffices.
    """
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use, opened = 0, 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = in_use >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                in_use &= ~(1 << room)
        else:
            room, bin_, opened = capacity, opened, opened + 1
        bins[item], places[item] = bin_, capacity - room
        room -= length
        if room:
            by_room[room].append(bin_)
            in_use |= 1 << room
    return bins, places


def _levels(groups: int, fan_in: int) -> int:
    """Levels of the tree above that many groups."""
    return 0 if groups <= 1 else 1 + _levels(-(-groups // fan_in), fan_in)


PLACED = PIECES + ", bin bigint, offset bigint"
MOVED = "bin bigint, into bigint, shift bigint, length bigint, open boolean, grp bigint"


def _pack_partition(capacity: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = list(batches)
        if own:
            rows = pd.concat(own, ignore_index=True)
            bins, places = best_fit(rows["length"].to_numpy(), capacity)
            yield rows.assign(bin=TaskContext.get().partitionId() * BINS_PER_PARTITION + bins, offset=places)

    return pack


def _of_use(totals: np.ndarray, equals: int) -> np.ndarray:
    """Marks ``equals`` bins of each total."""
    order = np.argsort(totals, kind="stable")
    ranked = totals[order]
    useful = np.empty(len(totals), bool)
    useful[order] = np.arange(len(totals)) - np.searchsorted(ranked, ranked) < equals
    return useful


def _pack_group(capacity: int, nearly_full: float, equals: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin", ignore_index=True)
        bins, places = best_fit(rows["length"].to_numpy(), capacity)
        total = np.bincount(bins, weights=rows["length"], minlength=1).astype(np.int64)
        heads = np.full(len(total), -1, np.int64)
        heads[bins[::-1]] = rows["bin"].to_numpy()[::-1]  # a bin is named after its first member
        open_ = (total < nearly_full * capacity) & _of_use(total, equals)
        return pd.DataFrame({
            "bin": rows["bin"], "into": heads[bins], "shift": places, "length": total[bins], "open": open_[bins],
            "grp": rows["grp"],
        })

    return pack


def pack(
    cut: DataFrame,
    folder: str,
    capacity: int = CAPACITY,
    nearly_full: float = NEARLY_FULL,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of :func:`pieces`.

    ``cut`` is a table: its partitions are the leaves of the tree. Sequence ids
    are unique and otherwise any numbers; offsets in a sequence have no gap. An
    empty table gives no row. Packing reorders and shifts rows, it drops none; a null
    doc_id and repeated ones are pieces like others.
    """
    leaves = cut.rdd.getNumPartitions()
    placed = written(cut.mapInPandas(_pack_partition(capacity), PLACED), f"{folder}/leaves")
    items = (
        placed.groupBy("bin")
        .agg(F.sum("length").alias("length"))
        .where(F.col("length") < nearly_full * capacity)
        .withColumn("grp", F.floor(F.col("bin") / BINS_PER_PARTITION))
    )
    moves, groups, level = None, leaves, 0
    while groups > 1:
        groups, level = -(-groups // fan_in), level + 1
        step = _pack_group(capacity, nearly_full, fan_in * _levels(groups, fan_in))
        merged = items.withColumn("grp", F.floor(F.col("grp") / fan_in)).groupBy("grp").applyInPandas(step, MOVED)
        merged = written(merged, f"{folder}/level-{level}")
        items = merged.where("open").groupBy(F.col("into").alias("bin"), "grp").agg(F.first("length").alias("length"))
        step_moves = merged.select("bin", "into", "shift")
        moves = step_moves if moves is None else _followed(moves, step_moves)
    if moves is None:
        return placed.withColumnRenamed("bin", "sequence_id")
    moves = written(moves, f"{folder}/moves")
    joined = placed.join(moves, "bin", "left")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def _followed(moves: DataFrame, step: DataFrame) -> DataFrame:
    """Where bins end up after one more level."""
    later = step.select(F.col("bin").alias("into"), F.col("into").alias("to"), F.col("shift").alias("by"))
    return moves.join(later, "into", "left").select(
        "bin", F.coalesce("to", "into").alias("into"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift")
    )

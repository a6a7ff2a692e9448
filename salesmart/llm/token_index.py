"""Token ids as raw binary shards, with keyed access through a minimal perfect hash.

A shard is two files. ``<shard>.ids`` holds the ids of its documents on end, as
little-endian unsigned integers of 16 bits, or of 32 where the vocabulary needs
them. ``<shard>.idx`` holds where each document begins, its key, and the index: a
minimal perfect hash maps the shard's distinct keys to slots 0..n-1 without
storing keys, and the slot holds a fingerprint of its key, the number of the first
row with that key and the count of such rows. A lookup hashes the key, reads one
slot and compares the fingerprint: constant time, no search. Each word of the hash
stands in the file beside the number of bits set before it, so a single key costs a
few reads of some bytes, however large the shard is; who asks for many keys of a shard
reads its index whole.

Documents lie in ascending order of their key over the shards, so the shards of a
key follow from the manifest's first and last keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from salesmart.llm.segments import mix, ragged, seeds
from salesmart.llm.shared import file_system, read_whole, write_whole, written
from salesmart.llm.tokens import text_encoder

END_ID = 0
MAGIC = 0x32584449  # "IDX2"
HEAD = 6  # numbers at the beginning of an index
#: Rows of a shard for each key asked from which on single reads are fewer than the index's.
ROWS_PER_KEY = 64
#: Bits per key at each level of the hash; more bits leave fewer levels.
BITS_PER_KEY = 2
SEEDS = seeds("levels", 64)
FINGERPRINT = seeds("print", 1)[0]

MANIFEST = "shard int, uri string, item_bytes int, n_docs bigint, n_tokens bigint, first_key bigint, last_key bigint"


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys, by levels of bit arrays.

    At each level the keys still unplaced are hashed into a bit array; those that
    meet no other key set their bit and are placed, the others go on to the next
    level. A key's slot is the number of bits set before its own.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.begins = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys * SEEDS[level % 64] + np.uint64(level)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], keys
        while len(left):
            size = -(-BITS_PER_KEY * len(left) // 64) * 64
            at = cls._place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        joined = np.concatenate(words) if words else np.empty(0, "<u8")
        return cls(np.array(sizes, np.int64), joined)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or some slot for keys that were not built in."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, begin) in enumerate(zip(self.sizes, self.begins)):
            bit = begin + self._place(keys[open_], level, int(size))
            word, low = bit >> 6, (bit & 63).astype(np.uint64)
            here = (self.words[word] >> low) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << low) - np.uint64(1))
            out[open_[here]] = (self.before[word] + np.bitwise_count(below).astype(np.int64))[here]
            open_ = open_[~here]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ FINGERPRINT) >> np.uint64(32)).astype("<u4")


def index_bytes(keys: np.ndarray, null_keys: int, offsets: np.ndarray) -> list[bytes]:
    """The parts of an index file; ``keys`` ascend and follow rows without a key."""
    named = keys[null_keys:]
    distinct, first, count = np.unique(named, return_index=True, return_counts=True)
    names = distinct.astype("<i8").view("<u8")
    hashed = PerfectHash.build(names)
    slot = hashed.slots(names)
    table = np.zeros((3, len(names)), "<u4")
    table[:, slot] = fingerprints(names), first + null_keys, count
    table = np.ascontiguousarray(table.T)
    head = np.array([MAGIC, len(keys), null_keys, len(names), len(hashed.sizes), len(hashed.words)], "<i8")
    ranked = np.stack([hashed.words.view("<i8"), hashed.before], axis=1)
    parts = (head, hashed.sizes, ranked, table, offsets, keys)
    return [p.astype(p.dtype if p.dtype == "<u4" else "<i8").tobytes() for p in parts]


class _Layout:
    """Where the parts of an index file begin."""

    def __init__(self, head: np.ndarray):
        if head[0] != MAGIC:
            raise ValueError("not an index file")
        self.rows, self.null_keys, self.names, self.levels, self.words = (int(x) for x in head[1:])
        self.sizes = 8 * HEAD
        self.hash = self.sizes + 8 * self.levels
        self.table = self.hash + 16 * self.words
        self.offsets = self.table + 12 * self.names
        self.keys = self.offsets + 8 * (self.rows + 1)


class ShardIndex:
    """An index file in memory."""

    def __init__(self, raw: bytes):
        at = _Layout(np.frombuffer(raw, "<i8", HEAD))
        self.null_keys = at.null_keys
        ranked = np.frombuffer(raw, "<i8", 2 * at.words, at.hash).reshape(-1, 2)
        self.hash = PerfectHash(np.frombuffer(raw, "<i8", at.levels, at.sizes), ranked[:, 0].copy().view("<u8"))
        self.prints, self.first, self.count = np.frombuffer(raw, "<u4", 3 * at.names, at.table).reshape(-1, 3).T
        self.offsets = np.frombuffer(raw, "<i8", at.rows + 1, at.offsets)
        self.keys = np.frombuffer(raw, "<i8", at.rows, at.keys)

    def rows_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key; 0 rows for keys that the shard lacks."""
        names = keys.astype("<i8").view("<u8")
        slot = self.hash.slots(names)
        found = slot >= 0
        found[found] = self.prints[slot[found]] == fingerprints(names[found])
        first, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[found], count[found] = self.first[slot[found]], self.count[slot[found]]
        return first, count

    def places_of(self, key: int) -> np.ndarray:
        """Where the key's rows begin in the payload, and where the last one ends; empty for none."""
        first, count = (int(x[0]) for x in self.rows_of(np.array([key], np.int64)))
        return self.offsets[first : first + count + 1] if count else np.empty(0, np.int64)


class IndexFile:
    """An index file read in places: a few bytes for a key."""

    def __init__(self, source):
        self.source = source
        self.at = _Layout(np.frombuffer(self._read(0, 8 * HEAD), "<i8"))
        self.sizes = np.frombuffer(self._read(self.at.sizes, 8 * self.at.levels), "<i8")

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _slot(self, name: np.ndarray) -> int:
        begin = 0
        for level, size in enumerate(self.sizes.tolist()):
            bit = begin + int(PerfectHash._place(name, level, size)[0])
            word, before = np.frombuffer(self._read(self.at.hash + 16 * (bit >> 6), 16), "<i8").tolist()
            word, low = word & 0xFFFFFFFFFFFFFFFF, bit & 63
            if word >> low & 1:
                return before + (word & (1 << low) - 1).bit_count()
            begin += size
        return -1

    def places_of(self, key: int) -> np.ndarray:
        """As of :class:`ShardIndex`."""
        name = np.array([key], "<i8").view("<u8")
        slot = self._slot(name)
        if slot < 0:
            return np.empty(0, np.int64)
        print_, first, count = np.frombuffer(self._read(self.at.table + 12 * slot, 12), "<u4").tolist()
        if print_ != int(fingerprints(name)[0]):
            return np.empty(0, np.int64)
        return np.frombuffer(self._read(self.at.offsets + 8 * first, 8 * (count + 1)), "<i8")


def with_end(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``END_ID`` after each document, and the new bounds."""
    return np.insert(ids, bounds[1:], END_ID), bounds + np.arange(len(bounds))


def write_shards(docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all whole texts below ``folder``; returns the manifest, one row per shard.

    Documents are dealt by ranges of their key. Null texts are empty. Rows that
    repeat a key follow each other, in the order of a hash of their texts, and may fill
    several shards; rows with a null key come first and have no entry in the index. An
    empty table gives no shard. A shard that is written again after a loss replaces the
    same files.
    """
    names = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"))
    names = names.withColumns({"print": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer)
        number = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{number:06d}"
        keys, lengths, payload, nulls = [], [], [], 0
        for batch in batches:
            ids, bounds = with_end(*encoder(batch.column("text")))
            column = batch.column("key")
            nulls += column.null_count
            keys.append(column.fill_null(0).to_numpy(zero_copy_only=False))
            lengths.append(np.diff(bounds))
            payload.append(ids.astype(encoder.dtype).tobytes())
        if not keys:
            return
        keys, lengths = np.concatenate(keys), np.concatenate(lengths)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        write_whole(f"{uri}.ids", payload)
        write_whole(f"{uri}.idx", index_bytes(keys, nulls, offsets))
        named = keys[nulls:]
        row = {
            "shard": number, "uri": uri, "item_bytes": np.dtype(encoder.dtype).itemsize,
            "n_docs": len(keys), "n_tokens": int(offsets[-1]),
            "first_key": int(named[0]) if len(named) else None, "last_key": int(named[-1]) if len(named) else None,
        }
        yield pa.RecordBatch.from_pylist([row], schema=_arrow(MANIFEST))

    order = [F.col("key").asc_nulls_first(), "print", "tie"]
    ordered = names.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    return written(ordered.mapInArrow(shard, MANIFEST), f"{folder}/manifest")


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, shard int"


def read_documents(manifest: DataFrame) -> DataFrame:
    """One row per document, from the files: place, length and checksum of its ids.

    Every key is looked up through its shard's index, and the ids of the rows that
    it names are read from the payload. ``start`` counts the ids of all documents
    before; the checksum is the CRC-32 of the ids as 32-bit little-endian integers.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = ShardIndex(read_whole(f"{row['uri']}.idx"))
                first, count = index.rows_of(index.keys[index.null_keys :])
                new = np.append(True, np.diff(index.keys[index.null_keys :]) != 0)[: len(first)]
                first, count = first[new], count[new]
                rows = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
                rows = np.concatenate([np.arange(index.null_keys), rows])
                files, path = file_system(f"{row['uri']}.ids")
                kind = np.dtype(f"<u{row['item_bytes']}")
                with files.open_input_file(path) as payload:
                    sums = []
                    for r in rows:
                        lo, hi = int(index.offsets[r]), int(index.offsets[r + 1])
                        payload.seek(lo * kind.itemsize)
                        ids = np.frombuffer(payload.read((hi - lo) * kind.itemsize), kind)
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                keys = pa.array(index.keys[rows], pa.int64(), mask=np.arange(len(rows)) < index.null_keys)
                yield pa.RecordBatch.from_arrays([
                    keys, pa.array(row["base"] + index.offsets[rows]),
                    pa.array(index.offsets[rows + 1] - index.offsets[rows]), pa.array(sums, pa.int64()),
                    pa.array([row["shard"]] * len(rows), pa.int32()),
                ], schema=_arrow(READ))

    # A row stands for a shard's files: each gets a task of its own.
    dealt = placed.withColumn("place", (F.row_number().over(Window.orderBy("shard")) - 1).cast("int"))
    return dealt.repartitionById(max(1, manifest.count()), "place").mapInArrow(read, READ)


def lookup(keys: DataFrame, manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """The ids of the documents with the given keys: ``key``, ``ids`` per document found.

    Keys are dealt to the shards by the manifest's first and last keys (two numbers per
    shard), so that a shard's index is read by one task only.
    """
    wanted = keys.select(F.col(key).cast("bigint").alias("key")).dropna().distinct()
    shards = manifest.dropna(subset=["first_key"]).orderBy("shard").collect()
    first_keys = np.array([s["first_key"] for s in shards], np.int64)
    last_keys = np.array([s["last_key"] for s in shards], np.int64)
    uris, sizes = [s["uri"] for s in shards], [s["item_bytes"] for s in shards]

    def owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(0).to_numpy()
            begin = np.searchsorted(last_keys, asked, "left")
            count = np.maximum(np.searchsorted(first_keys, asked, "right") - begin, 0)
            at = ragged(begin, count)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(np.repeat(asked, count), pa.int64()), "uri": pa.array([uris[i] for i in at], pa.string()),
                "item_bytes": pa.array([sizes[i] for i in at], pa.int32()),
            })

    owned = wanted.mapInArrow(owner, "key bigint, uri string, item_bytes int")

    def find(group: tuple, table: pa.Table) -> pa.Table:
        uri = group[0].as_py()
        kind = np.dtype(f"<u{table.column('item_bytes')[0].as_py()}")
        asked = table.column("key").to_pylist()
        files, path = file_system(uri)
        out_keys, out_ids = [], []
        with files.open_input_file(f"{path}.idx") as source, files.open_input_file(f"{path}.ids") as payload:
            index = IndexFile(source)
            if len(asked) * ROWS_PER_KEY > index.at.rows:
                index = ShardIndex(read_whole(f"{uri}.idx"))
            for key in asked:
                places = index.places_of(key).tolist()
                for lo, hi in zip(places, places[1:]):
                    payload.seek(lo * kind.itemsize)
                    out_keys.append(key)
                    out_ids.append(np.frombuffer(payload.read((hi - lo) * kind.itemsize), kind).astype(np.int64))
        return pa.table({"key": pa.array(out_keys, pa.int64()), "ids": pa.array(out_ids, pa.list_(pa.int64()))})

    return owned.groupBy("uri").applyInArrow(find, "key bigint, ids array<bigint>")


def encode_and_read(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    return read_documents(write_shards(docs, folder, tokenizer))

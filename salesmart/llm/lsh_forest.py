"""Near-duplicate documents by an LSH forest of minimum hashes.

A document is the set of its distinct shingles, of two words unless told otherwise; documents with equal sets
are one class. A class gets several independent sequences of minimum hashes, one
per tree, and each tree is the table sorted by its sequence. A prefix of the
sequence is a region of the tree. Regions are cut deeper until they hold few
classes, so depth adapts to how crowded a place is; within a region, and between
neighbours with the longest common prefix where a region was cut, classes are
candidates.

Candidates whose sketches agree too little for the similarity asked for are left
out, at odds of about 1e-6 for a true link. Of the others each task first gives a
spanning forest, whose links are confirmed on the full sets; then every candidate
pair that still lies in different components is confirmed too, unless bitmaps of the
two full sets already prove that they share too little. What remains unlinked has
been compared.

A tree cuts a crowded region, such as the documents of one template, so deep that
it may part linked classes. Classes of crowded regions are therefore joined
exactly as well, across components: two linked sets share one of their rarest
shingles (prefix filter), so classes that share one are candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.components import components
from salesmart.llm.segments import mix, ragged, range_hashes, seeds, text_bytes
from salesmart.llm.shared import shared_folder, written

TREES = 16
DEPTH = 12
#: Classes that a region may hold before it is cut deeper.
LEAF = 256
#: A pair whose trees share no region of this depth with more than LEAF classes is
#: missed with odds of (1 - 0.8**3)**16, about 1e-5; the others are joined exactly.
CROWDED_DEPTH = 3
#: Counters that order shingles by how common they are, and rows of a shingle in one block.
COUNTERS = 1 << 20
BLOCK = 1024
#: Pairs whose sketches, and whose larger maps, are compared at once.
PAIRS_AT_ONCE, MAPS_AT_ONCE = 1 << 15, 1 << 12
#: Bytes that agree in pairs joined at once, and pairs that wait for others.
SURE, WAITING = 52, 1 << 16
#: Bytes of a class's sketch (the first levels of all trees), and how many must agree.
SKETCH = 64
SKETCH_LEVELS = SKETCH // TREES
AGREE = 36
#: Bits of the map of a set's shingles that bounds what two sets share.
MAP_BITS = 1 << 12
#: Bits of the filter that picks the texts of linked documents: for each of them, and in all.
FILTER_BITS_EACH, FILTER_BITS = 16, (1 << 20, 1 << 27)
#: Bytes of text worked on at once, and shingles hashed at once.
TEXT_AT_ONCE = 1 << 20
SHINGLES_AT_ONCE = 2048

MINHASH = seeds("minhash", TREES * DEPTH)
#: Words of a shingle, as op6 defines it.
WORDS = 2
PAIR = seeds("shingle", 3)
LONGER = seeds("longer", 64)
NAME = seeds("setname", 2)

#: The bytes that part words.
BLANKS = [0x20, *range(0x09, 0x0E)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
INK = np.ones(256, bool)
INK[BLANKS] = False


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty for null and for no words.

    A text of fewer words than a shingle has is one shingle.
    """
    upto = np.cumsum(pc.binary_length(column.fill_null("")).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(column):
        limit = TEXT_AT_ONCE + (upto[at - 1] if at else 0)
        to = max(at + 1, int(np.searchsorted(upto, limit, "right")))
        yield from _shingles(column.slice(at, to - at), words)
        at = to


def _shingles(column: pa.Array, length: int) -> Iterator[np.ndarray]:
    data, texts = text_bytes(column)
    ink = np.zeros(len(data) + 2, bool)
    ink[1:-1] = INK[data]
    first = np.zeros(len(data) + 1, bool)  # a text's first byte, whatever stands before it
    first[texts] = True
    starts = np.flatnonzero(ink[1:-1] & (~ink[:-2] | first[:-1]))
    ends = np.flatnonzero(ink[1:-1] & (~ink[2:] | first[1:])) + 1
    words = range_hashes(LOWER[data], starts, ends)
    bounds = np.searchsorted(starts, texts)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        own = words[lo:hi]
        if length != WORDS and len(own) > 1:
            some = min(length, len(own))
            windows = np.lib.stride_tricks.sliding_window_view(own, some)
            yield np.unique(mix((windows * LONGER[:some]).sum(axis=1, dtype=np.uint64)))
        elif len(own) > 1:
            yield np.unique(mix(own[:-1] * PAIR[0] + own[1:] * PAIR[1]))
        else:
            yield mix(own * PAIR[2])


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of each minimum hash, as big-endian numbers that sort like their bytes."""
    low = np.full(TREES * DEPTH, ~np.uint64(0))
    for at in range(0, len(shingles), SHINGLES_AT_ONCE):
        some = shingles[at : at + SHINGLES_AT_ONCE]
        low = np.minimum(low, (some[:, None] * MINHASH).min(axis=0))
    return mix(low).astype(">u2")


PAIRS = "a bigint, b bigint"
SIGNED = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature binary, sketch binary"


def _signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, names, signs, sketches = [], [], [], []
        for own in shingle_sets(batch.column("text"), words):
            size.append(len(own))
            names.append([mix(own ^ n).sum(dtype=np.uint64) for n in NAME])
            sign = signature(own)
            signs.append(sign.tobytes())
            sketches.append((sign.reshape(TREES, DEPTH)[:, :SKETCH_LEVELS] & 0xFF).astype(np.uint8).tobytes())
        names = np.array(names, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]),
             pa.array(signs, pa.binary()), pa.array(sketches, pa.binary())],
            names=["doc_id", "n_shingles", "set_a", "set_b", "signature", "sketch"],
        )


def reaches(keys: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """For each sorted row, the place after the last row that it is compared with.

    A region of at most LEAF rows is compared within itself; a larger one is cut
    at the next depth, and where no depth is left, each row is compared with the
    LEAF rows after it; `_rare_pairs` finds the rest. Neighbours in a tree are
    compared in any case.
    """
    rows = len(keys)
    same = np.logical_and.accumulate(keys[1:] == keys[:-1], axis=1).sum(axis=1)
    prefix = np.concatenate([[-1], np.where(tree[1:] == tree[:-1], same, -1)])  # shared with the row before
    reach = np.zeros(rows, np.int64)
    for depth in range(keys.shape[1] + 1):
        starts = np.flatnonzero(prefix < depth)
        sizes = np.diff(np.append(starts, rows))
        end, size = np.repeat(starts + sizes, sizes), np.repeat(sizes, sizes)
        reach = np.where((reach == 0) & (size <= LEAF), end, reach)
    reach = np.where(reach == 0, np.minimum(end, np.arange(rows) + LEAF + 1), reach)
    beside = np.append(prefix[1:] >= 0, False)
    return np.where(beside, np.maximum(reach, np.arange(rows) + 2), reach)


def agreeing(sketch: np.ndarray, size: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows whose sketches and sizes allow a link, with how many bytes agree."""
    rows = np.arange(len(sketch))
    step = 1
    while len(rows := rows[reach[rows] > rows + step]):
        for at in range(0, len(rows), PAIRS_AT_ONCE):
            a = rows[at : at + PAIRS_AT_ONCE]
            b = a + step
            fits = 100 * np.minimum(size[a], size[b]) >= 80 * np.maximum(size[a], size[b])
            a, b = a[fits], b[fits]
            agree = (sketch[a] == sketch[b]).sum(axis=1)
            close = agree >= AGREE
            if close.any():
                yield a[close], b[close], agree[close]
        step += 1


class Forest:
    """A spanning forest of pairs that come in parts; beside the last parts it holds one number a node.

    Pairs that agree well are joined at once, the others when many have come, those
    that agree most first; pairs within a tree of the forest are let go.
    """

    def __init__(self, nodes: int):
        self.up = np.arange(nodes)
        self.waiting = np.empty((3, 0), np.int64)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        root = self.up[nodes]
        while (above := self.up[root]).size and (above != root).any():
            root = above
        self.up[nodes] = root
        return root

    def _apart(self, pairs: np.ndarray) -> np.ndarray:
        """Of the pairs (a, b, agree) between different trees, the one of any two trees that agrees most."""
        pairs = pairs[:, np.argsort(-pairs[2], kind="stable")]
        p, q = self.roots(pairs[0]), self.roots(pairs[1])
        names = np.minimum(p, q) * len(self.up) + np.maximum(p, q)
        first = np.sort(np.unique(names, return_index=True)[1])
        return pairs[:, first[p[first] != q[first]]]

    def _join(self, pairs: np.ndarray) -> np.ndarray:
        """Joins them in order; returns those that connected two trees."""
        up, kept = self.up, []
        for i, (x, y) in enumerate(zip(pairs[0].tolist(), pairs[1].tolist())):
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if x != y:
                up[y] = x
                kept.append(i)
        return pairs[:2, kept]

    def add(self, pairs: np.ndarray) -> np.ndarray:
        """Takes pairs (a, b, agree); returns links found so far, as (a, b)."""
        sure = pairs[2] >= SURE
        found = [self._join(self._apart(pairs[:, sure]))]
        self.waiting = np.concatenate([self.waiting, pairs[:, ~sure]], axis=1)
        if self.waiting.shape[1] > WAITING:
            self.waiting = self._apart(self.waiting)
            if self.waiting.shape[1] > WAITING // 2:
                found.append(self.rest())
        return np.concatenate(found, axis=1)

    def rest(self) -> np.ndarray:
        links = self._join(self._apart(self.waiting))
        self.waiting = self.waiting[:, :0]
        return links


def _bit_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for own in batch.column("shingles").to_pylist():
            bits = np.zeros(MAP_BITS, bool)
            bits[np.frombuffer(own, "<u8") % MAP_BITS] = True
            maps.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(maps, pa.binary())], names=["rep", "map"])


def can_link(a: np.ndarray, b: np.ndarray, maps: np.ndarray, size: np.ndarray, lost: np.ndarray) -> np.ndarray:
    """Whether pairs may reach the similarity; a no is certain.

    Common shingles set common bits, but for those that share a bit with another
    one of their set; ``lost`` counts a set's shingles beyond its bits.
    """
    common = np.minimum(lost[a], lost[b])
    for at in range(0, len(a), MAPS_AT_ONCE):
        some = slice(at, at + MAPS_AT_ONCE)
        common[some] += np.bitwise_count(maps[a[some]] & maps[b[some]]).sum(axis=1, dtype=np.int64)
    return 180 * common >= 80 * (size[a] + size[b])


def _candidates(batches: Iterator[pa.RecordBatch], across: bool) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of a sorted partition: a forest of them, or those across components."""
    own = [b for b in batches if b.num_rows]
    if not own:
        return
    table = pa.Table.from_batches(own).combine_chunks()
    keys = np.frombuffer(b"".join(table.column("key").to_pylist()), ">u2").reshape(-1, DEPTH)
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    size, rep = table.column("n_shingles").to_numpy(), table.column("rep").to_numpy()
    if across:
        part = table.column("component").to_numpy()
        maps = np.frombuffer(b"".join(table.column("map").to_pylist()), "<u8").reshape(-1, MAP_BITS // 64)
        lost = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    pairs = agreeing(sketch, size, reaches(keys, table.column("tree").to_numpy()))
    if across:
        for a, b, _ in pairs:
            apart = np.flatnonzero(part[a] != part[b])
            apart = apart[can_link(a[apart], b[apart], maps, size, lost)]
            yield _pairs_batch(rep[a[apart]], rep[b[apart]])
        return
    reps, node = np.unique(rep, return_inverse=True)
    links = Forest(len(reps))
    for a, b, agree in pairs:
        yield _pairs_batch(*reps[links.add(np.stack([node[a], node[b], agree]))])
    yield _pairs_batch(*reps[links.rest()])


def _pairs_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs, the smaller one first."""
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _forest_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _candidates(batches, across=False)


def _pairs_across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _candidates(batches, across=True)


def similar(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether 100 * intersection >= 80 * union, on full sets."""
    common = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * common >= 80 * (len(one) + len(other) - common)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [
            similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"))
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())
        ]
        kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        yield kept


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar; one set of a pair travels to the other."""
    with_a = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("set_a")), "a")
    with_b = with_a.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("set_b")), "b")
    return with_b.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed, PAIRS)


def _trees(reps: DataFrame, *more: str) -> DataFrame:
    """A row for each class and tree, each tree sorted by its sequence; ranges cut anywhere."""
    key = F.expr(f"substring(signature, tree * {2 * DEPTH} + 1, {2 * DEPTH})").alias("key")
    rows = reps.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
    rows = rows.select("tree", key, "rep", "n_shingles", "sketch", *more)
    return rows.repartitionByRange("tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")


def filter_bits(wanted: int) -> int:
    """A power of two with room for that many, within bounds."""
    least, most = FILTER_BITS
    return min(most, max(least, 1 << (FILTER_BITS_EACH * wanted).bit_length()))


def _sets_of(docs: DataFrame, wanted: DataFrame, path: str, words: int) -> DataFrame:
    """rep, shingles of the documents in ``wanted`` (rep), read again from the texts.

    A filter, of 16 megabytes at most, drops most other texts where they are read; a join
    of what is left decides.
    """
    size = filter_bits(wanted.count())
    slot = F.pmod(F.xxhash64("rep"), F.lit(size))
    bits = wanted.select(slot.alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")
    )
    held = np.zeros(size // 64, np.int64)
    for part in bits.toArrow().to_batches():
        held[part.column("word").to_numpy()] = part.column("bits").to_numpy()
    held = held.view(np.uint64)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy()
            some = batch.filter(pa.array((held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))
            found = [own.astype("<u8").tobytes() for own in shingle_sets(some.column("text"), words)]
            yield pa.RecordBatch.from_arrays([some.column("rep"), pa.array(found, pa.binary())], names=["rep", "shingles"])

    rows = docs.select(F.col("doc_id").alias("rep"), "text").where("rep is not null").withColumn("slot", slot)
    read = rows.mapInArrow(sets, "rep bigint, shingles binary")
    # A doc_id that repeats with other texts: any one of its sets would do, so take the least.
    mine = read.join(wanted, "rep", "left_semi").groupBy("rep").agg(F.min("shingles").alias("shingles"))
    return written(mine, path)


def _crowded(reps: DataFrame, path: str) -> DataFrame:
    """rep of the classes that lie in a region of more than LEAF classes at CROWDED_DEPTH."""
    start = f"substring(signature, tree * {2 * DEPTH} + 1, {2 * CROWDED_DEPTH})"
    rows = reps.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
    rows = rows.select("rep", F.xxhash64("tree", F.expr(start)).alias("region"))
    large = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAF).select("region")
    return written(rows.join(written(large, f"{path}/regions"), "region", "left_semi").select("rep").distinct(), f"{path}/classes")


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for own in batch.column("shingles").to_pylist():
            np.add.at(total, (np.frombuffer(own, "<u8") % COUNTERS).astype(np.int64), 1)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["counter", "n"])


def prefix_lengths(size: int) -> tuple[int, int]:
    """How many of a set's rarest shingles it is asked for as the smaller and as the larger of a pair.

    Sets of a similarity of 0.8 share 8/9 of the smaller one and 4/5 of the larger
    one at least, so these parts of the two have a shingle in common, whatever the
    order is, as long as it is one for all.
    """
    return size - (8 * size + 8) // 9 + 1, size - (4 * size + 4) // 5 + 1


RARE = "shingle bigint, rep bigint, component bigint, n_shingles bigint, indexed boolean"


def _rare_shingles(common: np.ndarray):
    """The rarest shingles of each set; ``indexed`` are those that it is asked for as the smaller."""

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, size, index = [np.empty(0, np.uint64)], [], [np.empty(0, bool)]
            for held in batch.column("shingles").to_pylist():
                own = np.frombuffer(held, "<u8")
                indexed, asked = prefix_lengths(len(own))
                found.append(own[np.lexsort((own, common[(own % COUNTERS).astype(np.int64)]))[:asked]])
                index.append(np.arange(asked) < indexed)
                size.append(len(own))
            counts = np.array([len(f) for f in found[1:]], np.int64)
            row = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found).view(np.int64)), batch.column("rep").take(row), batch.column("component").take(row),
                 pa.array(np.repeat(np.array(size, np.int64), counts)), pa.array(np.concatenate(index))],
                names=["shingle", "rep", "component", "n_shingles", "indexed"],
            )

    return rare


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates across components among the rows of each block; rows are sorted by block and component."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*rest, batch]).combine_chunks()
        keys = np.stack([table.column(c).to_numpy() for c in BLOCK_KEY])
        last = int(np.flatnonzero((keys != keys[:, -1:]).any(axis=0)).max(initial=-1)) + 1  # where the last block begins
        yield from _pairs_of_blocks(table.slice(0, last))
        rest = table.slice(last).to_batches()
    if rest:
        yield from _pairs_of_blocks(pa.Table.from_batches(rest))


BLOCK_KEY = ["shingle", "one", "other"]


def _pairs_of_blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    table = table.combine_chunks()
    keys = np.stack([table.column(c).to_numpy() for c in BLOCK_KEY])
    part, rep = table.column("component").to_numpy(), table.column("rep").to_numpy()
    size, indexed = table.column("n_shingles").to_numpy(), table.column("indexed").to_numpy()
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    maps = np.frombuffer(b"".join(table.column("map").to_pylist()), "<u8").reshape(-1, MAP_BITS // 64)
    lost = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
    rows = len(rep)
    new = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))
    ends = lambda first: np.append(np.flatnonzero(first)[1:], rows)[np.cumsum(first) - 1]
    block_end, part_end = ends(new), ends(new | np.append(True, part[1:] != part[:-1]))
    upto = np.cumsum(block_end - part_end)
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(upto, PAIRS_AT_ONCE + (upto[at - 1] if at else 0), "right")))
        a, b = np.repeat(np.arange(at, to), (block_end - part_end)[at:to]), ragged(part_end[at:to], (block_end - part_end)[at:to])
        fits = 100 * np.minimum(size[a], size[b]) >= 80 * np.maximum(size[a], size[b])
        fits &= (indexed[a] & (size[a] <= size[b])) | (indexed[b] & (size[b] <= size[a]))
        a, b = a[fits], b[fits]
        close = (sketch[a] == sketch[b]).sum(axis=1) >= AGREE
        a, b = a[close], b[close]
        may = can_link(a, b, maps, size, lost)
        yield _pairs_batch(rep[a[may]], rep[b[may]])
        at = to


def _rare_pairs(crowd: DataFrame, reps: DataFrame, path: str) -> DataFrame:
    """Pairs (a, b) across components of ``crowd`` (rep, component, shingles) that share a rare shingle.

    Shingles of one component only are left out before rows meet; the rows of a
    common one are dealt to blocks, and every two blocks meet in a group of their own.
    Pairs whose bitmaps prove that they share too little do not leave it.
    """
    common = np.zeros(COUNTERS, np.int64)
    counted = crowd.mapInArrow(_shingle_counts, "counter bigint, n bigint").groupBy("counter").agg(F.sum("n").alias("n"))
    for part in counted.toArrow().to_batches():
        common[part.column("counter").to_numpy()] = part.column("n").to_numpy()
    rare = written(crowd.mapInArrow(_rare_shingles(common), RARE), f"{path}/rare")
    shared = rare.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("least"), F.max("component").alias("most"), F.max("indexed").alias("asked")
    )
    shared = shared.where("least < most and asked").selectExpr("shingle", f"cast(ceil(n / {BLOCK}) as int) as blocks")
    rows = rare.join(shared, "shingle").withColumn("block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)"))
    rows = rows.withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumn("one", F.least("block", "with")).withColumn("other", F.greatest("block", "with"))
    maps = crowd.mapInArrow(_bit_maps, "rep bigint, map binary")
    held = written(maps.join(reps.select("rep", "sketch"), "rep"), f"{path}/maps")
    rows = rows.join(held, "rep").select(*BLOCK_KEY, "component", "rep", "n_shingles", "indexed", "sketch", "map")
    met = rows.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY, "component", "rep")
    return met.mapInArrow(_block_pairs, PAIRS).distinct()


def near_duplicates(
    docs: DataFrame, folder: str | None = None, key: str = "doc_id", text: str = "text", words: int = WORDS
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of shingles of ``words`` words (64 at most)
    have a Jaccard similarity of 0.8 or more; ``component_id`` is the smallest doc_id that links reach. Documents
    without words are linked with nothing. Rows are told apart by their doc_id,
    which should be distinct; a null doc_id is linked with nothing, has a null
    component and is kept. Other columns are ignored, an empty table gives no row.
    """
    if not 1 <= words <= len(LONGER):
        raise ValueError(f"words must be from 1 to {len(LONGER)}")
    folder = folder or shared_folder(docs.sparkSession, "lsh-forest")
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = written(rows.mapInArrow(lambda batches: _signed(batches, words), SIGNED), f"{folder}/signed")
    name = ["set_a", "set_b", "n_shingles"]
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = linkable.groupBy(*name).agg(F.min("doc_id").alias("rep"))
    one = F.struct("doc_id", "signature", "sketch")
    reps = linkable.groupBy(*name).agg(F.min(one).alias("one")).select(
        F.col("one.doc_id").alias("rep"), "n_shingles", "one.signature", "one.sketch"
    )
    reps = written(reps, f"{folder}/classes")

    pairs = written(_trees(reps).mapInArrow(_forest_pairs, PAIRS).distinct(), f"{folder}/pairs")
    active = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    crowded = _crowded(reps, f"{folder}/crowded")
    wanted = written(active.union(crowded).distinct(), f"{folder}/wanted")
    sets = _sets_of(rows, wanted, f"{folder}/sets", words)
    links = written(_linked(pairs, sets), f"{folder}/links")
    parts = written(components(links, f"{folder}/first"), f"{folder}/first-parts")

    crowd = sets.join(crowded, "rep", "left_semi").join(parts, F.col("rep") == F.col("node"), "left")
    crowd = crowd.select("rep", F.coalesce("component", "rep").alias("component"), "shingles")
    rare = _rare_pairs(written(crowd, f"{folder}/crowd"), reps, f"{folder}/rare")

    # Only classes of some candidate pair can have one across components.
    maps = sets.mapInArrow(_bit_maps, "rep bigint, map binary")
    among = reps.join(maps, "rep").join(parts, F.col("rep") == F.col("node"), "left")
    among = among.withColumn("component", F.coalesce("component", "rep"))
    met = _trees(among, "component", "map").mapInArrow(_pairs_across, PAIRS).union(rare)
    untested = met.distinct().join(pairs, ["a", "b"], "left_anti")
    more = written(_linked(written(untested, f"{folder}/across"), sets), f"{folder}/more-links")
    final = components(links.unionByName(more), f"{folder}/second")

    of_rep = classes.join(final, F.col("rep") == F.col("node"), "left").select(
        *(F.col(c).alias(f"_{c}") for c in name), F.coalesce("component", "rep").alias("component_id")
    )
    same = (F.col("set_a") == F.col("_set_a")) & (F.col("set_b") == F.col("_set_b")) & (F.col("n_shingles") == F.col("_n_shingles"))
    whole = signed.select("doc_id", *name).join(of_rep, same, "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return whole.select("doc_id", "n_shingles", own.cast("bigint").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )

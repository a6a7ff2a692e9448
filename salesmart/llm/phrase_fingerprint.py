"""Lempel-Ziv phrase fingerprints: likeness of texts as a compressor sees it.

A text is parsed by LZ78: each phrase is the longest one seen before plus one
character. Texts that share much share many phrases. The set of phrases is hashed
and kept as the minimum of each of 64 hash functions; the share of equal minima
estimates the share of common phrases.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.segments import mix, seeds
from salesmart.llm.shared import with_fields

MINIMA = 64
#: Phrases hashed at once; bounds the memory for long texts.
PHRASES_AT_ONCE = 1 << 14
MULTIPLIERS = seeds("phrases", MINIMA)
CHARACTER = seeds("letters", 2)
#: The minima of no phrase at all.
NOTHING = np.full(MINIMA, 0xFFFFFFFF, np.uint32)


class Parse:
    """An LZ78 parse that can be carried on, and taken back to where it was.

    Phrases tile the text, so the places where they end say what they are; the
    trie of phrases is only needed to find them.
    """

    def __init__(self):
        self.trie: dict = {}
        self.node, self.ends, self.added = self.trie, [], []

    def read(self, text: str, begin: int) -> None:
        """Reads on; ``begin`` is the place of ``text`` in the whole."""
        root, node, end, note = self.trie, self.node, self.ends.append, self.added.append
        for at, character in enumerate(text, begin + 1):
            following = node.get(character)
            if following is None:
                node[character] = {}
                note((node, character))
                end(at)
                node = root
            else:
                node = following
        self.node = node

    def mark(self) -> tuple:
        return self.node, len(self.ends)

    def back_to(self, mark: tuple) -> None:
        self.node, count = mark
        for node, character in self.added[count:]:
            del node[character]
        del self.added[count:], self.ends[count:]


def minima(text: str, ends: list[int], begin: int = 0) -> np.ndarray:
    """Smallest values of the hash functions over the phrases from ``begin`` on that end at ``ends``."""
    out = NOTHING.copy()
    for at in range(0, len(ends), PHRASES_AT_ONCE):
        to = np.array(ends[at : at + PHRASES_AT_ONCE], np.int64)
        lo = begin if at == 0 else ends[at - 1]
        points = np.frombuffer(text[lo : int(to[-1])].encode("utf-32-le"), "<u4").astype(np.uint64)
        names = phrase_hashes(points, np.append(lo, to[:-1]) - lo, to - lo)
        for some in np.array_split(names, -(-len(names) // 2048)):
            low = (some[:, None] * MULTIPLIERS).min(axis=0) >> np.uint64(32)
            out = np.minimum(out, low.astype(np.uint32))
    return out


def phrase_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of code points."""
    place = np.arange(len(points)) - np.repeat(starts, ends - starts)
    sums = np.add.reduceat(mix(points * CHARACTER[0] + place.astype(np.uint64) * CHARACTER[1]), starts)
    return mix(sums + (ends - starts).astype(np.uint64))


def _closed(parse: Parse, length: int) -> list[int]:
    """The ends of all phrases; one left open at the end of the text counts like the others."""
    return parse.ends if parse.node is parse.trie else [*parse.ends, length]


def fingerprint(text: str | None) -> np.ndarray:
    """Of a whole text; null as empty."""
    text, parse = text or "", Parse()
    parse.read(text, 0)
    return minima(text, _closed(parse, len(text)))


def text_and_edit(text: str, kept: int, tail: str) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``text`` and of its first ``kept`` characters followed by ``tail``.

    Both parses begin alike, so the common beginning is parsed and hashed once.
    """
    parse = Parse()
    parse.read(text[:kept], 0)
    mark, common = parse.mark(), len(parse.ends)
    base = minima(text, parse.ends)
    from_ = parse.ends[-1] if common else 0
    out = []
    for whole in (text, text[:kept] + tail):
        parse.read(whole[kept:], kept)
        own = _closed(parse, len(whole))[common:]
        out.append(np.minimum(base, minima(whole, own, from_)))
        parse.back_to(mark)
    return out[0], out[1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal minima, 0 to 1; two texts without phrases are alike."""
    return float((a == b).mean())


def printed(minima_: np.ndarray) -> str:
    return minima_.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each whole text; a column of that name is replaced."""
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    rows = docs.select(*kept)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [printed(fingerprint(t)) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, pa.string())], names=[*batch.schema.names, into]
            )

    return rows.mapInArrow(add, with_fields(rows, f"`{into}` string"))


NEXT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
LEAST = -(1 << 63)


def compare_with_edited(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprint of each text, of its edited text, and their likeness.

    The edited text ends in the beginning of the next document by ``doc_id`` (the
    last one takes the first): the last half is replaced by as many characters, or
    all, of that document. Rows that repeat a doc_id follow the order of their
    texts; a null doc_id comes first, null texts are empty.

    Texts move once. The doc_ids are cut into ranges at ids that occur, and the
    rows with the first id of a range also go to the range before it, so that its
    last document finds the next one there. ``ranges`` defaults to the session's
    shuffle partitions.
    """
    spark = docs.sparkSession
    wanted = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST)).alias("at"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    shares = [i / wanted for i in range(1, wanted)]
    found = rows.agg(
        F.min("at").alias("least"),
        F.percentile_approx("at", shares or [0.5], 100 * wanted).alias("cuts"),
    ).first()  # as many numbers as there are ranges
    firsts = np.array(sorted({found["least"], *(found["cuts"] if shares else [])}), np.int64) if found["cuts"] else None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            own = np.searchsorted(firsts, at, "right") - 1
            lead = np.flatnonzero(firsts[own] == at)
            before = (own[lead] - 1) % len(firsts)
            both = np.concatenate([np.arange(len(at)), lead])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([own, before]).astype(np.int32)),
                 pa.array(np.arange(len(both)) >= len(at)), batch.column(0).take(pa.array(both)),
                 batch.column(1).take(pa.array(both))],
                names=["range", "borrowed", "at", "text"],
            )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # tries hold no cycles
        waiting: _Waiting | None = None  # the row whose next document is still to come
        for batch in batches:
            out: list[dict] = []
            for rng, borrowed, at, text in zip(*(c.to_pylist() for c in batch.columns)):
                if waiting is not None and waiting.range == rng:
                    waiting.meet(text, out)
                    following = _Waiting(rng, at, text, after=waiting)
                    waiting = following.borrowed(out) if borrowed else following
                elif not borrowed:  # else the range before has met its next document already
                    waiting = _Waiting(rng, at, text)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_schema())

    if firsts is None:
        return spark.createDataFrame([], NEXT)
    dealt = rows.mapInArrow(deal, "range int, borrowed boolean, at bigint, text string")
    # By the number itself: by its hash, some tasks would get several ranges and others none.
    ordered = dealt.repartitionById(len(firsts), "range").sortWithinPartitions("range", "borrowed", "at", "text")
    return ordered.mapInArrow(compare, NEXT)


class _Waiting:
    """A document, until the next one is known; ``after`` waits for this one's fingerprint."""

    def __init__(self, range_: int, at: int, text: str, after: _Waiting | None = None):
        self.range, self.at, self.text, self.after = range_, at, text, after
        self.own: np.ndarray | None = None
        self.row: dict | None = None

    def meet(self, following: str, out: list[dict]) -> None:
        text, half = self.text, len(self.text) // 2
        kept, tail = len(text) - half, following[:half]
        self.own, edited = text_and_edit(text, kept, tail)
        self.row = {
            "doc_id": None if self.at == LEAST else self.at,
            "n_chars": len(text),
            "edited_sha256": hashlib.sha256((text[:kept] + tail).encode()).hexdigest(),
            "fingerprint": printed(self.own),
            "edited_fingerprint": printed(edited),
            "near_edited": likeness(self.own, edited),
        }
        self._tell(self.own, out)

    def borrowed(self, out: list[dict]) -> None:
        """Another range's first document: only its fingerprint counts here."""
        self._tell(fingerprint(self.text), out)

    def _tell(self, own: np.ndarray, out: list[dict]) -> None:
        if self.after is not None:
            out.append(self.after.row | {"near_next": likeness(self.after.own, own)})
            self.after = None


def _schema() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in NEXT.split(", "))])

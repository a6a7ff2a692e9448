"""Whole columns of text as byte arrays: hashes of many ranges at once, and a memo by segment.

Ranges of bytes (words, chunks) are named by 64-bit hashes of their bytes and places.
Short ranges never share a hash; two longer ones do with odds of about 1 to 2**64 a
pair, also where they hold the same bytes in another order. The memo compares bytes
as well.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; bounds the memory of the hashes.
WINDOW = 1 << 20

BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (the splitmix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(name: str, count: int) -> np.ndarray:
    """Fixed odd 64-bit numbers, the same on every machine."""
    start = np.frombuffer(name.encode().ljust(8, b"-")[:8], "<u8")[0]
    with np.errstate(over="ignore"):
        return mix(start + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


#: Ranges of up to this many bytes are named by the bytes themselves, without any clash.
SHORT = 7
HELD = np.array([(1 << 8 * n) - 1 for n in range(SHORT + 1)], np.uint64)
#: What a byte adds to the name of a longer range depends on its value and its place there.
BYTE_VALUE = seeds("byte", 256)
PLACE = seeds("place", 1)[0]
NEAR_PLACES = 64
NEAR = mix(BYTE_VALUE[None, :] + np.arange(NEAR_PLACES, dtype=np.uint64)[:, None] * PLACE).reshape(-1)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; ranges ascend and do not overlap."""
    if not len(starts):
        return np.empty(0, np.uint64)
    size = ends - starts
    begin = int(starts[0])
    held = np.append(data[begin : int(ends[-1])], np.zeros(8, np.uint8))
    eight = np.ndarray(len(held) - 7, "<u8", held, strides=(1,))  # from each byte on
    few = np.minimum(size, SHORT)
    names = (eight[starts - begin] & HELD[few]) | size.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > SHORT)
    if len(long):
        names[long] = _sums(data, starts[long], ends[long]) + size[long].astype(np.uint64)
    return mix(names)


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the hashes of each byte with its place; windows may cut a range, whose parts add up."""
    sums = np.zeros(len(starts), np.uint64)
    first = 0
    for lo in range(int(starts[0]), int(ends[-1]), WINDOW):
        hi = min(lo + WINDOW, int(ends[-1]))
        first += int(np.searchsorted(ends[first:], lo, "right"))
        last = first + int(np.searchsorted(starts[first:], hi, "left"))
        if first == last:
            continue
        s, e = np.maximum(starts[first:last], lo), np.minimum(ends[first:last], hi)
        where = ragged(s, e - s)
        parts = _byte_hashes(data[where], where - np.repeat(starts[first:last], e - s))
        sums[first:last] += np.add.reduceat(parts, np.cumsum(e - s) - (e - s))
    return sums


def _byte_hashes(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of each byte with its place; those of the first places stand in a table."""
    out = NEAR[np.minimum(place, NEAR_PLACES - 1) << 8 | data]
    far = np.flatnonzero(place >= NEAR_PLACES)
    if len(far):
        out[far] = mix(BYTE_VALUE[data[far]] + place[far].astype(np.uint64) * PLACE)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts on end, and the n + 1 places where texts begin; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all elements of the given slices, slice after slice."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _classes() -> np.ndarray:
    """Bits per byte: 1 letter, 2 mark that always starts a new token after a letter, 4 other ink."""
    kind = np.zeros(256, np.uint8)
    kind[0x21:0x7F] = 4
    for letters in (range(0x41, 0x5B), range(0x61, 0x7B)):
        kind[letters.start : letters.stop] |= 1
    for mark in b",.!?;:*#$%&":
        kind[mark] |= 2
    return kind


KIND = _classes()
SPACE, NEWLINE = 0x20, 0x0A


def chunk_starts(data: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Places where a byte-level BPE splits whatever surrounds them, and the beginnings of texts.

    The split pattern never joins ink with the space or line break after it, a lone
    line break with the ink after it, or a letter with the mark after it, and none
    of its alternatives looks back. Ink is
    taken from ASCII and from two-byte characters beyond U+00BF, none of which is
    white space in any version of Unicode; letters likewise.
    """
    if not len(data):
        return np.empty(0, np.int64)
    kind = KIND[data]
    before, lead = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    before[1:], lead[2:] = kind[:-1], data[:-2]
    two = (lead >= 0xC3) & (lead <= 0xDF)  # then the byte before ends a two-byte character
    ink = (before & 4).astype(bool) | two
    latin = two & (lead == 0xC3)
    last = np.zeros(len(data), np.uint8)
    last[1:] = data[:-1]
    letter = (before & 1).astype(bool) | (latin & (last != 0x97) & (last != 0xB7))
    cut = ink & ((data == SPACE) | (data == NEWLINE)) | letter & (kind & 2).astype(bool)
    lone = np.flatnonzero(cut & (data == NEWLINE)) + 1  # after a line break between ink and ink
    lone = lone[lone < len(data)]
    cut[lone[(kind[lone] & 4).astype(bool)]] = True
    cut[texts[:-1][texts[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


class SegmentMemo:
    """Ids of texts from the ids of their segments, each distinct segment encoded once.

    ``starts_of(data, text_offsets)`` cuts, ``encode(text)`` gives a segment's ids.
    A segment is known by its hash and its bytes, so one that shares another's hash is
    encoded by itself. The memo is emptied when it holds more than ``remembered``
    segments, or eight times as many ids or bytes.
    """

    def __init__(self, encode: Callable[[str], Sequence[int]], dtype: str, remembered: int = 1_000_000):
        self.encode, self.dtype, self.remembered = encode, np.dtype(dtype), remembered
        self._clear()

    def _clear(self) -> None:
        self.names = np.empty(0, np.uint64)  # ascending
        self.first = np.empty(0, np.int64)  # of each name's ids in flat
        self.count = np.empty(0, np.int64)
        self.flat = np.empty(0, self.dtype)
        self.begin = np.empty(0, np.int64)  # of each name's bytes in spelled
        self.size = np.empty(0, np.int64)
        self.spelled = np.empty(0, np.uint8)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end, and the n + 1 places where those of each text begin."""
        flats, bounds, total, at = [np.empty(0, self.dtype)], [np.zeros(1, np.int64)], 0, 0
        upto = np.cumsum(pc.binary_length(column.fill_null("")).to_numpy(zero_copy_only=False))
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(upto, WINDOW + (upto[at - 1] if at else 0), "right")))
            flat, own = self._some(column.slice(at, to - at))
            flats.append(flat)
            bounds.append(own[1:] + total)
            total, at = total + len(flat), to
        return np.concatenate(flats), np.concatenate(bounds)

    def _some(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts of about a window, or one longer text, whose segments come in windows."""
        data, texts = text_bytes(column)
        starts = chunk_starts(data, texts)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        flats, counts, at = [np.empty(0, self.dtype)], [np.empty(0, np.int64)], 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + WINDOW, "right")))
            flat, count = self._window(data, starts[at:to], ends[at:to])
            flats.append(flat)
            counts.append(count)
            at = to
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(flats), total[np.searchsorted(starts, texts)]

    def _window(self, data, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        names = range_hashes(data, starts, ends)
        distinct, where, back = np.unique(names, return_index=True, return_inverse=True)
        at = np.searchsorted(self.names, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.names)
        known[inside] = self.names[at[inside]] == distinct[inside]
        if not known.all():
            new = where[~known]
            self._remember(distinct[~known], data, starts[new], ends[new], at[~known])
            at = np.searchsorted(self.names, distinct)
        mine = at[back]
        first, count = self.first[mine], self.count[mine]
        flat = self.flat[ragged(first, count)]
        other = self._spelled_otherwise(data, starts, ends - starts, mine)
        if len(other):
            flat, count = self._replaced(flat, count, other, [self._encoded(data, starts[i], ends[i]) for i in other])
        if len(self.names) > self.remembered or max(len(self.flat), len(self.spelled)) > 8 * self.remembered:
            self._clear()
        return flat, count

    def _encoded(self, data: np.ndarray, start: int, end: int) -> Sequence[int]:
        return self.encode(data[start:end].tobytes().decode())

    def _spelled_otherwise(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Segments whose bytes are not those remembered under their name."""
        equal = sizes == self.size[at]
        compared = np.flatnonzero(equal & (sizes > SHORT))  # shorter ones are their names
        here = data[ragged(starts[compared], sizes[compared])]
        there = self.spelled[ragged(self.begin[at[compared]], sizes[compared])]
        differ = np.flatnonzero(here != there)
        if len(differ):
            equal[compared[np.searchsorted(np.cumsum(sizes[compared]), differ, "right")]] = False
        return np.flatnonzero(~equal)

    def _replaced(self, flat, count, at, ids: list[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
        parts = np.split(flat, np.cumsum(count)[:-1])
        for i, own in zip(at.tolist(), ids):
            parts[i] = np.array(own, self.dtype)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _remember(self, names: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> None:
        ids = [self._encoded(data, s, e) for s, e in zip(starts.tolist(), ends.tolist())]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        first = len(self.flat) + np.cumsum(count) - count
        flat = np.fromiter((i for own in ids for i in own), self.dtype, int(count.sum()))
        size = ends - starts
        begin = len(self.spelled) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, flat])
        self.spelled = np.concatenate([self.spelled, data[ragged(starts, size)]])
        self.names = np.insert(self.names, at, names)
        self.first, self.count = np.insert(self.first, at, first), np.insert(self.count, at, count)
        self.begin, self.size = np.insert(self.begin, at, begin), np.insert(self.size, at, size)

"""Language identification by a bit-sliced Bloom filter over character n-grams.

Each slot of the filter is a bitmask of languages. An n-gram is entered for a
language by setting that language's bit in its slots; the AND of its slots is the
bitmask of all languages that hold it, found by one probe for all of them. A text
is decided by its per-language popcounts, corrected for the false positives that
each language's fill of the filter makes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.llm.segments import mix, seeds
from salesmart.llm.shared import with_fields

SIZE = 4
HASHES = 4
SLOTS_PER_GRAM = 16
#: Labelled documents that the filter is fitted on, about.
TRAIN_ROWS = 20_000
#: Labelled documents that a rare language has among them, about, or all if there are fewer.
LEAST_ROWS = 100
#: Languages learned, the most frequent ones; bounds what the driver and each plan hold.
LANGUAGES = 1024
#: Share of a language's documents that must hold an n-gram, and how far it may lie
#: below the language that holds it most.
LEAST_SHARE = 0.01
LEAST_OF_MOST = 0.5
#: Share of a language's usual hits below which a text is not in it, and by how many
#: standard deviations a short text may lie below that.
LEAST_OF_USUAL = 0.5
DEVIATIONS = 2
UNDECIDED = "und"
GRAM = seeds("gram", SIZE)
PROBE = seeds("probe", HASHES)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, the text of each, and which texts have a letter.

    Letters are lower-cased, each run of other characters is one space, and a text
    stands between spaces.
    """
    points = np.frombuffer(" ".join((t or "").lower() for t in texts).encode("utf-32-le"), "<u4")
    lengths = np.array([len((t or "").lower()) + 1 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    points = np.concatenate([[32], points, [32]]).astype(np.int64)  # the last text's space is here, too
    owner = np.concatenate([[-1], owner])
    letter = _letters()[points]
    has_letter = np.bincount(owner[1:][letter[1:]], minlength=len(texts))[: len(texts)] > 0
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1]  # the first of a run of other characters
    points, owner, letter = points[kept], owner[kept], letter[kept]
    points = np.where(letter, points, 32).astype(np.uint64)
    count = len(points) - SIZE + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), has_letter
    names = np.zeros(count, np.uint64)
    for i in range(SIZE):
        names += points[i : i + count] * GRAM[i]
    last = owner[SIZE - 1 :]
    # Not across texts: the space before a text counts as its own.
    same = owner[1 : count + 1] == last
    return mix(names)[same], last[same], has_letter


class BitSlicedFilter:
    """Languages, the filter's words of 64 languages per slot, and false positive rates."""

    def __init__(self, languages: list[str], words: np.ndarray):
        self.languages, self.words = languages, words
        bits = [(words[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(len(languages))]
        self.false = np.array([float(b.mean()) ** HASHES for b in bits])

    @classmethod
    def build(cls, languages: list[str], names: np.ndarray, masks: np.ndarray) -> BitSlicedFilter:
        """``masks``: for each n-gram its languages, one row of 64-bit words."""
        slots = 1 << max(10, math.ceil(math.log2(max(1, len(names)) * SLOTS_PER_GRAM)))
        words = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
        for seed in PROBE:
            np.bitwise_or.at(words, cls._slot(names, seed, slots), masks)
        return cls(languages, words)

    @staticmethod
    def _slot(names: np.ndarray, seed: np.uint64, slots: int) -> np.ndarray:
        return ((names * seed) >> np.uint64(64 - int(math.log2(slots)))).astype(np.int64)

    def languages_of(self, names: np.ndarray) -> np.ndarray:
        """Bitmask of the languages that hold each n-gram (or seem to)."""
        found = self.words[self._slot(names, PROBE[0], len(self.words))]
        for seed in PROBE[1:]:
            found &= self.words[self._slot(names, seed, len(self.words))]
        return found

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Corrected counts of each text and language, all n-grams of each text, and which texts have a letter."""
        names, owner, has_letter = grams(texts)
        masks = self.languages_of(names)
        total = np.bincount(owner, minlength=len(texts))[: len(texts)]
        hits = np.zeros((len(texts), len(self.languages)))
        for i, rate in enumerate(self.false):
            bit = ((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)
            own = np.bincount(owner[bit], minlength=len(texts))[: len(texts)]
            hits[:, i] = np.maximum(0, (own - total * rate) / (1 - min(rate, 0.999)))
        return hits, total, has_letter

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its share of the corrected counts; the first language where nothing is known."""
        hits, _, has_letter = self.hits(texts)
        best = hits.argmax(axis=1) if self.languages else np.zeros(len(texts), np.int64)
        score = np.zeros(len(texts))
        sums = hits.sum(axis=1)
        decided = has_letter & (sums > 0)
        score[decided] = hits[decided, best[decided]] / sums[decided]
        known = has_letter if self.languages else np.zeros(len(texts), bool)
        return [self.languages[b] if k else UNDECIDED for b, k in zip(best, known)], score


def held_out(key: Column) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def in_language(hits: np.ndarray, total: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Whether the best language claims each text: some hits, and not far fewer of the text's
    n-grams than are usual in that language.

    An n-gram shares letters with SIZE - 1 others, so counts vary as if there were
    only a SIZE-th of them; a text of a few words is rejected for want of any hit only.
    """
    if not len(usual):
        return np.zeros(len(total), bool)
    best = hits.argmax(axis=1)
    most, rate = hits[np.arange(len(hits)), best], usual[best]
    allowed = DEVIATIONS * np.sqrt(SIZE * total * rate * (1 - rate))
    return (most > 0) & (most >= LEAST_OF_USUAL * rate * total - allowed)


def training_rows(docs: DataFrame, train_rows: int = TRAIN_ROWS, key: str = "doc_id") -> DataFrame:
    """The labelled documents that :func:`fit` learns from.

    All if there are at most ``train_rows``, else a share of them, but of a language
    with fewer than LEAST_ROWS in that share about LEAST_ROWS, or all it has if there
    are fewer; so every labelled language has some. Of more than LANGUAGES languages the
    most frequent are learned.
    """
    labelled = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))
    )
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")
    first = {r["lang"]: r["n"] for r in counts.limit(LANGUAGES + 1).collect()}
    rows = dict(list(first.items())[:LANGUAGES])
    if len(first) > len(rows):
        labelled = labelled.where(F.col("lang").isin(list(rows)))
    total = sum(rows.values())
    if total <= train_rows:
        return labelled
    limit = lambda share: F.lit(int(min(share, 1) * (1 << 40)))
    common = train_rows / total
    rare = {x: LEAST_ROWS / n for x, n in rows.items() if n * common < LEAST_ROWS}
    most = limit(common)
    if rare:
        own = F.create_map(*(c for x, share in rare.items() for c in (F.lit(x), limit(share))))
        most = F.coalesce(own[F.col("lang")], most)
    return labelled.where(F.pmod(F.xxhash64(F.lit("fit"), key), F.lit(1 << 40)) < most)


def usual_rates(docs: DataFrame, model: BitSlicedFilter, train_rows: int = TRAIN_ROWS, key: str = "doc_id") -> np.ndarray:
    """For each language of ``model``, the share of its training documents' n-grams that it holds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(model.languages)))
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            lang = np.array([model.languages.index(x) for x in batch.column("lang").to_pylist()], np.int64)
            for some in _by_size(texts):
                own = lang[at : at + len(some)]
                at += len(some)
                hits, total, _ = model.hits(some)
                np.add.at(sums[0], own, hits[np.arange(len(some)), own])
                np.add.at(sums[1], own, total)
        held = [pa.array(np.arange(len(model.languages), dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])]
        yield pa.RecordBatch.from_arrays(held, names=["lang", "hits", "total"])

    rows = training_rows(docs, train_rows, key)
    narrow = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = narrow.mapInArrow(count, "lang int, hits double, total double").groupBy("lang")
    usual = np.zeros(len(model.languages))
    for r in counted.agg(F.sum("hits").alias("hits"), F.sum("total").alias("total")).collect():
        usual[r["lang"]] = r["hits"] / max(r["total"], 1)
    return usual


def in_known_language(docs: DataFrame, model: BitSlicedFilter, usual: np.ndarray, text: str = "text") -> DataFrame:
    """The rows whose text the best language claims, see :func:`in_language`; none without a letter."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [np.empty(0, bool)]
            for some in _by_size(batch.column(text).to_pylist()):
                hits, total, has_letter = model.hits(some)
                known.append(has_letter & in_language(hits, total, usual))
            yield batch.filter(pa.array(np.concatenate(known)))

    return docs.mapInArrow(keep, docs.schema)


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, key: str = "doc_id") -> BitSlicedFilter:
    """Learns from text and lang of documents that are not held out.

    Takes about ``train_rows`` of them, chosen by a hash of their key, or all if
    there are fewer, and more of rare languages, see :func:`training_rows`. N-grams are counted by document in Spark; only those that a
    hundredth of a language's documents hold come to the driver, at most a hundred
    times the n-grams of an average document. Rows with null text, lang or key
    teach nothing.
    """
    labelled = training_rows(docs, train_rows, key)
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").collect()
    languages = [r["lang"] for r in sizes]  # most frequent first
    if not languages:
        return BitSlicedFilter([], np.zeros((1024, 1), np.uint64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {c: batch.column(c).to_pylist() for c in ("text", "lang")}
            at = 0
            for some in _by_size(of["text"]):
                lang = np.array([languages.index(x) for x in of["lang"][at : at + len(some)]], np.int32)
                at += len(some)
                names, owner, _ = grams(some)
                once = np.unique(mix(names + mix(owner.astype(np.uint64))), return_index=True)[1]  # per document
                names, by = names[once], lang[owner[once]]
                for i in np.unique(by):
                    seen, held = np.unique(names[by == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(seen), i, np.int32)), pa.array(seen.view(np.int64)), pa.array(held)],
                        names=["lang", "gram", "docs"],
                    )

    narrow = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = narrow.mapInArrow(count, "lang int, gram bigint, docs bigint").groupBy("gram", "lang").agg(F.sum("docs").alias("docs"))
    size_of = F.element_at(F.array(*(F.lit(float(r["n"])) for r in sizes)), F.col("lang") + 1)
    shares = counted.select("gram", "lang", (F.col("docs") / size_of).alias("share"))
    held = shares.groupBy("gram").agg(F.max("share").alias("most"), F.collect_list(F.struct("lang", "share")).alias("all"))
    enough = lambda s: (s["share"] >= LEAST_SHARE) & (s["share"] >= LEAST_OF_MOST * F.col("most"))
    kept = held.where(F.col("most") >= LEAST_SHARE).select(
        "gram", F.transform(F.filter("all", enough), lambda s: s["lang"]).alias("langs")
    )
    table = kept.toArrow()
    names = table.column("gram").to_numpy().view(np.uint64)
    masks = np.zeros((len(names), -(-len(languages) // 64)), np.uint64)
    for row, own in enumerate(table.column("langs").to_pylist()):
        for i in own:
            masks[row, i // 64] |= np.uint64(1 << (i % 64))
    return BitSlicedFilter.build(languages, names, masks)


def identify(docs: DataFrame, model: BitSlicedFilter, text: str = "text") -> DataFrame:
    """Adds lang_pred and score by the whole text; columns of those names are replaced.

    ``und`` with score 0 where the text is null, empty or has no letter, or no language
    was learned. Rows stay as they are, also with null or repeated keys.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    rows = docs.select(*kept)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs, scores = batch.column(text).to_pylist(), [], []
            for some in _by_size(texts):
                own, score = model.predict(some)
                langs += own
                scores.append(score)
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate([np.empty(0), *scores]))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(predict, with_fields(rows, "lang_pred string, score double"))


def _by_size(texts: list[str | None], characters: int = 1 << 19) -> Iterator[list[str | None]]:
    """Runs of texts of about so many characters, to bound the memory of their n-grams."""
    some, held = [], 0
    for one in texts:
        some.append(one)
        held += len(one or "")
        if held >= characters:
            yield some
            some, held = [], 0
    if some:
        yield some

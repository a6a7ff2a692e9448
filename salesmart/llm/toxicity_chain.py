"""Toxicity categories by a chain of linear classifiers.

The categories are predicted one after the other: each classifier sees the words
of the text and the probabilities of the categories before it. For training, those
probabilities are out of fold: a document's come from a classifier that was fitted
without it, so later classifiers learn from predictions as good as they will get.

Words count with their beginnings, as inflected forms of a word share those. Spark
counts in how many labelled texts, and in how many of each category, every word
stands; the classifiers use those that tell a category best.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.llm.segments import mix, range_hashes, seeds, text_bytes
from salesmart.llm.shared import with_fields, written

#: Labelled documents that the chain is fitted on, at most, and words it may use.
TRAIN_ROWS = 20_000
FEATURES = 512
FOLDS = 3
#: Texts that must hold a word, and standard deviations that its share of a category
#: must lie from that category's share of all texts.
LEAST_TEXTS = 5
LEAST_Z = 5.0
#: Lengths in bytes of word beginnings that count beside whole words.
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.5
ROUNDS = 300
PENALTY = 1e-5
TEXT_AT_ONCE = 1 << 20

LENGTH_MARK = seeds("begin", len(BEGINNINGS) + 1)
#: Letters of ASCII, and all bytes of other characters.
LETTER = np.array([chr(b).isascii() and chr(b).isalpha() or b > 127 for b in range(256)])


def words_and_beginnings(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words and their beginnings, and the text of each."""
    data, bounds = text_bytes(pa.array([(t or "").lower() + "\n" for t in texts], pa.string()))
    ink = np.zeros(len(data) + 1, bool)
    ink[1:] = LETTER[data]
    starts = np.flatnonzero(ink[1:] & ~ink[:-1])
    ends = np.flatnonzero(ink[:-1] & ~np.append(ink[1:], False)[: len(data)])
    owner = np.searchsorted(bounds, starts, "right") - 1
    names, owners = [mix(range_hashes(data, starts, ends) ^ LENGTH_MARK[0])], [owner]
    for mark, length in zip(LENGTH_MARK[1:], BEGINNINGS):
        long = ends - starts >= length
        names.append(mix(range_hashes(data, starts[long], starts[long] + length) ^ mark))
        owners.append(owner[long])
    return np.concatenate(names), np.concatenate(owners)


def _by_size(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of bounded size, with the place of the first."""
    begin, held = 0, 0
    for at, one in enumerate(texts):
        held += len(one or "")
        if held >= TEXT_AT_ONCE:
            yield begin, texts[begin : at + 1]
            begin, held = at + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


class Words:
    """The words that the classifiers know, by hash."""

    def __init__(self, names: np.ndarray):
        self.names = np.sort(names)

    def __len__(self) -> int:
        return len(self.names)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of text and known word, each once."""
        rows, columns = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for begin, some in _by_size(texts):
            names, owner = words_and_beginnings(some)
            at = np.minimum(np.searchsorted(self.names, names), max(0, len(self) - 1))
            hit = self.names[at] == names if len(self) else np.zeros(len(names), bool)
            pairs = np.unique(owner[hit] * max(1, len(self)) + at[hit])
            rows.append(begin + pairs // max(1, len(self)))
            columns.append(pairs % max(1, len(self)))
        return np.concatenate(rows), np.concatenate(columns)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Linear:
    """Logistic regression over known words and the probabilities before."""

    def __init__(self, words: np.ndarray, before: np.ndarray, bias: float):
        self.words, self.before, self.bias = words, before, bias

    def probability(self, rows: np.ndarray, columns: np.ndarray, before: np.ndarray) -> np.ndarray:
        margin = np.bincount(rows, weights=self.words[columns], minlength=len(before))
        return _sigmoid(margin + before @ self.before + self.bias)

    @classmethod
    def fit(cls, rows: np.ndarray, columns: np.ndarray, before: np.ndarray, truth: np.ndarray, size: int) -> Linear:
        """Accelerated gradient descent; equal labels, or none, give a constant."""
        share = float(truth.mean()) if len(truth) else 0.0
        if share in (0.0, 1.0):
            return cls(np.zeros(size), np.zeros(before.shape[1]), 30.0 if share else -30.0)
        steep = np.bincount(columns, minlength=size) / (4 * len(truth)) + PENALTY  # curvature of each weight
        most = max(1, np.bincount(rows, minlength=len(truth)).max() + before.shape[1] + 1)
        start = float(np.log(share / (1 - share)))
        weights = np.concatenate([np.zeros(size + before.shape[1]), [start]])
        last, moving = weights.copy(), weights.copy()
        rate = np.concatenate([1 / (steep * np.sqrt(most)), np.full(before.shape[1] + 1, 4 / np.sqrt(most))])
        for number in range(ROUNDS):
            model = cls(moving[:size], moving[size:-1], moving[-1])
            error = model.probability(rows, columns, before) - truth
            gradient = np.concatenate([
                np.bincount(columns, weights=error[rows], minlength=size) / len(truth) + PENALTY * moving[:size],
                before.T @ error / len(truth) + PENALTY * moving[size:-1],
                [error.mean()],
            ])
            weights = moving - rate * gradient
            moving = weights + number / (number + 3) * (weights - last)
            last = weights
        return cls(weights[:size], weights[size:-1], float(weights[-1]))


class Chain:
    """One classifier per category, in the order of prediction."""

    def __init__(self, categories: Sequence[str], words: Words, models: Sequence[Linear]):
        self.categories, self.words, self.models = list(categories), words, list(models)

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        rows, columns = self.words.of(texts)
        out = np.zeros((len(texts), 0))
        for model in self.models:
            out = np.column_stack([out, model.probability(rows, columns, out)])
        return out

    def predict(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Adds ``p_<category>`` for each category by the whole text, null as empty; an empty
        text has the probability that the fit gives to no known word. Rows stay as they are, also
        with null or repeated keys; an empty table gives no row.

        Columns of those names are replaced, all others pass.
        """
        names = [f"p_{c}" for c in self.categories]
        rows = docs.select(*(c for c in docs.columns if c.lower() not in {n.lower() for n in names}))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = self.probabilities(batch.column(text).to_pylist())
                columns = [*batch.columns, *(pa.array(p) for p in found.T)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names])

        return rows.mapInArrow(add, with_fields(rows, ", ".join(f"`{n}` double" for n in names)))


def _each_text(training: DataFrame, categories: Sequence[str]) -> DataFrame:
    """One row for equal texts; where their labels differ, the largest counts."""
    return training.groupBy("text").agg(*(F.max(c).alias(c) for c in categories))


def _counts(training: DataFrame, categories: Sequence[str]) -> DataFrame:
    """For each word: texts that hold it, and those of each category. Equal texts count once."""
    once = _each_text(training, categories)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            truth = np.stack([batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in categories])
            for begin, some in _by_size(texts):
                names, owner = words_and_beginnings(some)
                first = np.unique(mix(names + mix(owner.astype(np.uint64))), return_index=True)[1]
                found, which = np.unique(names[first], return_inverse=True)
                ones = [np.bincount(which, weights=t[begin + owner[first]]).astype(np.int64) for t in truth]
                columns = [found.view(np.int64), np.bincount(which), *ones]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "n", *categories])

    schema = "word bigint, n bigint, " + ", ".join(f"`{c}` bigint" for c in categories)
    counted = once.mapInArrow(count, schema)
    return counted.groupBy("word").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in categories))


def _telling(training: DataFrame, categories: Sequence[str], features: int) -> Words:
    """The words that lie farthest from the categories' shares."""
    texts = _each_text(training, categories)
    shares = texts.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in categories)).first()
    z = [
        F.abs(F.col(c) - F.col("n") * shares[c]) / F.sqrt(F.col("n") * shares[c] * (1 - shares[c]))
        for c in categories
        if 0 < shares[c] < 1
    ]
    if not z:
        return Words(np.empty(0, np.uint64))
    most = F.greatest(*z, F.lit(0.0))
    counted = _counts(training, categories).where(F.col("n") >= LEAST_TEXTS).withColumn("z", most)
    best = counted.where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(features)
    return Words(best.select("word").toArrow().column(0).to_numpy().view(np.uint64))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[str],
    folder: str,
    train_rows: int = TRAIN_ROWS,
    features: int = FEATURES,
    folds: int = FOLDS,
    key: str = "doc_id",
    text: str = "text",
) -> Chain:
    """Fits the chain on at most ``train_rows`` labelled documents, chosen by a hash of their key.

    Labels are 0 or 1; of several rows for a document the largest counts, and a
    null label teaches its category nothing. Labels without a document and null
    keys are left out. Without labels, or with equal ones only, a category's
    probability is near 0 or 1 throughout. The known words of the chosen documents
    come to the driver, no more than ``train_rows`` lists of ``features`` numbers.
    """
    told = labels.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), *categories)
    told = told.groupBy("key").agg(*(F.max(c).cast("int").alias(c) for c in categories))
    chosen = told.orderBy(F.xxhash64(F.lit("chain"), "key"), "key").limit(train_rows)  # so it may be broadcast
    texts = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    training = written(texts.join(F.broadcast(chosen), "key"), f"{folder}/training")
    words = _telling(training, categories, features)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns = words.of(batch.column("text").to_pylist())
            ends = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(columns, pa.int64()))
            kept = [batch.column(c) for c in ("fold", *categories)]
            yield pa.RecordBatch.from_arrays([*kept, lists], names=["fold", *categories, "words"])

    fold = F.pmod(F.xxhash64(F.lit("fold"), "key"), F.lit(folds)).cast("int")
    schema = "fold int, " + ", ".join(f"`{c}` int" for c in categories) + ", words array<bigint>"
    table = training.withColumn("fold", fold).mapInArrow(known, schema).toArrow().combine_chunks()
    lists = table.column("words").to_pylist()
    rows = np.repeat(np.arange(len(lists)), [len(own) for own in lists])
    columns = np.array([w for own in lists for w in own], np.int64)
    folded = table.column("fold").to_numpy()

    def fitted(part: np.ndarray, before: np.ndarray, truth: np.ndarray) -> Linear:
        place = np.cumsum(part) - 1
        mine = part[rows]
        return Linear.fit(place[rows[mine]], columns[mine], before[part], truth[part], len(words))

    models, before = [], np.zeros((len(lists), 0))
    for category in categories:
        truth = table.column(category).to_numpy(zero_copy_only=False).astype(np.float64)
        taught = ~np.isnan(truth)
        models.append(fitted(taught, before, truth))
        unseen = np.zeros(len(lists))
        for f in range(folds):
            model = fitted(taught & (folded != f), before, truth)
            unseen = np.where(folded == f, model.probability(rows, columns, before), unseen)
        before = np.column_stack([before, unseen])
    return Chain(categories, words, models)


def toxic(threshold: float = THRESHOLD, category: str = "toxic") -> Column:
    return F.col(f"p_{category}") >= threshold

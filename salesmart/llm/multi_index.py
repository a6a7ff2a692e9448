"""Nearest neighbours by cosine through an inverted multi-index.

Unit vectors are cut into two halves and each half is quantised by its own k
centroids, which makes k * k cells. A query visits the cells by ascending sum of
its two distances: a heap over the two sorted distance lists yields the next pair
without sorting all. It stops when the visited cells hold the wanted share of all
vectors; their entries are reranked by the exact cosine.

The centroids, and the share that reaches the wanted recall, are fitted on a
bounded sample; every vector is indexed. A cell's row of the grid is dealt to
blocks, so a crowded cell is many tasks, and a block returns its k best for each
query, never its pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesmart.llm.shared import with_fields, written

#: Centroids of each half.
CENTROIDS = 32
#: Vectors that the centroids and the visited share are fitted on, and probes for the share.
SAMPLE_ROWS = 20_000
PROBES = 200
TARGET_RECALL = 0.96
#: Entries of a block and queries that meet them, about.
BLOCK_ROWS = 4096
QUERY_ROWS = 20_000
#: Gap below which matrix products don't tell scores apart; such pairs are scored singly.
CLOSE = 1e-9


def usable(embedding: Column, dimension: int | None = None) -> Column:
    """Whether a vector takes part: no null, only finite components, not all zero, right length."""
    value = lambda x: x.cast("double")
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")))
    right = F.lit(True) if dimension is None else F.size(embedding) == dimension
    return embedding.isNotNull() & right & finite & F.exists(embedding, lambda x: value(x) != 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1, in double precision; scaled by powers of two first, which is exact."""
    _, power = np.frexp(np.abs(vectors).max(axis=1, initial=0))
    scaled = np.ldexp(vectors, -power[:, None])
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, on original vectors. Equal pairs give equal values wherever they stand."""
    (_, p), (_, q) = np.frexp(np.abs(a).max(axis=1)), np.frexp(np.abs(b).max(axis=1))
    a, b = np.ldexp(a, -p[:, None]), np.ldexp(b, -q[:, None])
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    return np.clip(dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))), -1.0, 1.0)


def quantise(half: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * half @ centroids.T, axis=1)


def fit_centroids(half: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """k-means from a seeded choice of distinct rows; empty clusters keep their centre."""
    distinct = np.unique(half, axis=0)
    chosen = np.random.default_rng(seed).permutation(len(distinct))[:k]
    centroids = distinct[np.sort(chosen)].copy()
    for _ in range(rounds):
        near = quantise(half, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, half)
        count = np.bincount(near, minlength=len(centroids))
        centroids[count > 0] = sums[count > 0] / count[count > 0, None]
    return centroids


class Codebook:
    """Centroids of the two halves."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second = first, second

    @classmethod
    def fit(cls, units: np.ndarray, k: int) -> Codebook:
        h = units.shape[1] // 2
        return cls(fit_centroids(units[:, :h], k, 1), fit_centroids(units[:, h:], k, 2))

    def cells(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        return quantise(units[:, :h], self.first), quantise(units[:, h:], self.second)

    def distances(self, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        return ((one[:h] - self.first) ** 2).sum(axis=1), ((one[h:] - self.second) ** 2).sum(axis=1)

    def traverse(self, one: np.ndarray) -> Iterator[tuple[int, int]]:
        """All cells by ascending sum of distances."""
        a, b = self.distances(one)
        by_a, by_b = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        a, b = a[by_a].tolist(), b[by_b].tolist()
        heap = [(a[0] + b[0], 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield by_a[i], by_b[j]
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))

    def visited(self, one: np.ndarray, counts: np.ndarray, wanted: int) -> np.ndarray:
        """Grid of the cells that together hold at least ``wanted`` vectors, nearest first."""
        grid, held = np.zeros(counts.shape, bool), 0
        for i, j in self.traverse(one):
            if held >= wanted:
                break
            grid[i, j] = True
            held += int(counts[i, j])
        return grid

    def share_for(self, units: np.ndarray, recall: float, top: int = 5) -> float:
        """Share of all vectors to visit so that sampled probes find their neighbours."""
        if len(units) <= top + 1:
            return 1.0
        i, j = self.cells(units)
        counts = np.zeros((len(self.first), len(self.second)), np.int64)
        np.add.at(counts, (i, j), 1)
        needed: list[float] = []
        for probe in range(0, len(units), -(-len(units) // PROBES)):
            score = units @ units[probe]
            score[probe] = -2
            cells = list(self.traverse(units[probe]))
            order = np.full(counts.shape, 0, np.int64)
            order[tuple(np.array(cells).T)] = np.cumsum([counts[c] for c in cells])
            nearest = np.argsort(-score, kind="stable")[:top]
            needed += (order[i[nearest], j[nearest]] / len(units)).tolist()
        return float(min(1.0, np.quantile(needed, recall)))


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return np.stack(values).astype(np.float64) if len(values) else np.empty((0, 0))


FOUND = "query_id bigint, vec_id bigint, score double"


def _best(queries: pd.DataFrame, entries: pd.DataFrame, top: int) -> pd.DataFrame:
    """Each query's best entries of this block, from the cells it visits."""
    out = []
    entries = entries.sort_values("vec_id", kind="stable", ignore_index=True)
    own, ids, cell = _matrix(entries["embedding"]), entries["vec_id"].to_numpy(), entries["j"].to_numpy()
    units = unit(own)
    repeats = int(np.unique(ids, return_counts=True)[1].max())  # rows that share a vec_id
    for at in range(0, len(queries), 256):
        some = queries.iloc[at : at + 256]
        asked, names = _matrix(some["embedding"]), some["query_id"].to_numpy()
        wanted = np.unpackbits(np.stack([np.frombuffer(m, np.uint8) for m in some["cells"]]), axis=1).astype(bool)
        open_ = wanted[:, cell] & (names[:, None] != ids[None, :])
        score = np.where(open_, unit(asked) @ units.T, -np.inf)
        count = min((top + 1) * repeats, score.shape[1])
        bar = -np.partition(-score, count - 1, axis=1)[:, count - 1] - CLOSE
        q, e = np.nonzero(open_ & (score >= bar[:, None]))
        out.append(pd.DataFrame({"query_id": names[q], "vec_id": ids[e], "score": cosines(asked[q], own[e])}))
    found = pd.concat(out)
    found = found.groupby(["query_id", "vec_id"], as_index=False)["score"].max()
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return found.groupby("query_id").head(top)


def nearest(
    vectors: DataFrame,
    queries: Column,
    folder: str,
    top: int = 5,
    centroids: int = CENTROIDS,
    sample_rows: int = SAMPLE_ROWS,
    target_recall: float = TARGET_RECALL,
    key: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """The ``top`` nearest of every row for which ``queries`` holds: query_id, rank, vec_id, score.

    Candidates are all rows with another key. Vectors that are null, zero, hold
    null or non-finite components, differ from the most frequent length or lack a
    key take no part. Rows that repeat a key are one candidate, scored by its best
    row, and one query, by its smallest vector. Ties go to the smaller key. A table
    without usable vectors gives no row.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = vectors.select(
        F.col(key).cast("bigint").alias("vec_id"), F.col(embedding).alias("embedding"), queries.alias("asks")
    ).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = rows.agg(F.mode(F.size("embedding"), True).alias("dimension")).first()
    if sizes["dimension"] is None:
        return empty
    rows = rows.where(F.size("embedding") == sizes["dimension"])
    sampled = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("embedding").toArrow()
    sample = unit(_matrix(sampled.column(0).combine_chunks()))
    book = Codebook.fit(sample, centroids)
    share = book.share_for(sample, target_recall, top)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                i, j = book.cells(unit(_matrix(batch.column("embedding"))))
                both = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *both], names=[*batch.schema.names, "i", "j"])

    entries = written(rows.mapInArrow(index, with_fields(rows, "i int, j int")), f"{folder}/index")
    held = entries.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).collect()
    counts = np.zeros((len(book.first), len(book.second)), np.int64)  # centroids squared, at most
    for cell in held:
        counts[cell["i"], cell["j"]] = cell["n"]
    total, asked = int(counts.sum()), sum(cell["q"] for cell in held)
    wanted = min(total, max(int(np.ceil(share * total)), 64 * (top + 1)))
    blocks = np.maximum(1, -(-counts.sum(axis=1) // BLOCK_ROWS)).tolist()
    parts = max(1, -(-asked // QUERY_ROWS))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"query_id": [], "embedding": [], "i": [], "cells": []}
            found = _matrix(batch.column("embedding")) if batch.num_rows else []
            for name, original, one in zip(batch.column("vec_id").to_pylist(), found, unit(found) if len(found) else []):
                grid = book.visited(one, counts, wanted)
                for i in np.flatnonzero((grid & (counts > 0)).any(axis=1)).tolist():
                    out["query_id"].append(name)
                    out["embedding"].append(original)
                    out["i"].append(i)
                    out["cells"].append(np.packbits(grid[i]).tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("query_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("i", pa.int32()), ("cells", pa.binary()),
            ]))

    block_of = F.element_at(F.array(*map(F.lit, blocks)), F.col("i") + 1)
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    asking = entries.where("asks").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    visits = asking.mapInArrow(visit, "query_id bigint, embedding array<double>, i int, cells binary")
    visits = visits.withColumn("part", part).withColumn("block", F.explode(F.sequence(F.lit(0), block_of - 1)))
    listed = entries.select(
        "vec_id", "embedding", "i", "j", F.pmod(F.xxhash64("vec_id"), block_of).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
    )

    def score(asking: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if len(asking) and len(own):
            return _best(asking, own, top)
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    meet = ["i", "block", "part"]
    found = visits.groupBy(*meet).cogroup(listed.groupBy(*meet)).applyInPandas(score, FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")

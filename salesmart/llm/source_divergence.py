"""How far the sources of a language differ in their use of words.

Words are counted per language and source; a language keeps the words that occur in
enough of its documents. The counts form a matrix of sources by words, mostly zeros
where sources differ. Its columns are dealt to tiles by hash, its rows to blocks,
and for every two blocks of a tile a task builds a K2-tree: a square cut into
quadrants again and again, of which only those holding a count are kept. Every two
sources walk the tree jointly: a quadrant that is empty for both is priced at once,
its width times the constant difference of what the two give to an unseen word; only
leaves with a count are compared one by one. Sums over tiles give the divergences.

All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesmart.llm.segments import text_bytes
from salesmart.llm.shared import shared_folder, written

#: Documents of a language that a word has to occur in.
KEPT_IN = 30
#: What is added to every count, and what probabilities are multiplied by.
PRIOR, SCALE = 5, 1_000_000_000
#: Words of a tile (on average) and sources of a block.
TILE_WORDS, BLOCK_SOURCES = 1024, 256
#: Parts into which the words of a language are dealt where they meet its totals.
SALTS = 64
#: Words that rank in a report of a group.
TOP_TERMS = 50
#: Words held in a counting task before they are handed on.
HELD = 200_000
#: Bytes of text cut into words at once, and joint nodes walked at once.
TEXT_AT_ONCE, NODES_AT_ONCE = 1 << 20, 1 << 20

#: Words are runs of ASCII letters and non-ASCII bytes; only A-Z are lowered.
LETTERS = bytes(
    c + 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in order, about a megabyte of text at a time."""
    letters = text.translate(LETTERS)
    at = 0
    while at < len(letters):
        gap = letters.find(b" ", at + TEXT_AT_ONCE)
        to = len(letters) if gap < 0 else gap
        yield letters[at:to].split()
        at = to


COUNTED = "lang string, source string, term string, n bigint, docs bigint"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by (lang, source, term), and documents that hold it, summed up in the task before they leave."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for batch in batches:
        data, bounds = text_bytes(batch.column("text"))
        keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        for key, start, end in zip(keys, bounds[:-1].tolist(), bounds[1:].tolist()):
            total, docs = counts.setdefault(key, (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in words_of(data[start:end].tobytes()):
                total.update(words)
                seen.update(words)
            docs.update(seen)
        if sum(len(total) for total, _ in counts.values()) > HELD:
            yield from _rows(counts)
            counts.clear()
    yield from _rows(counts)


def _rows(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (total, docs) in counts.items():
        size = len(total)
        terms = pa.array(list(total), pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), terms,
             pa.array(list(total.values()), pa.int64()), pa.array([docs[t] for t in total], pa.int64())],
            names=["lang", "source", "term", "n", "docs"],
        )


def _probability(n: str, size: str) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (size + PRIOR * v)), exact."""
    above = f"cast({n} + {PRIOR} as decimal(20,0)) * cast({SCALE} as decimal(10,0))"
    return F.expr(f"1 + ({above}) div cast({size} + {PRIOR} * v as decimal(20,0))")


def probabilities(n: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The same of counts and ``below`` = size + PRIOR * v, by long division in base 1000: no product overflows."""
    quotient, rest = np.zeros(len(n), np.int64), n + PRIOR
    step = 1000
    whole, rest = np.divmod(rest, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * step, below)
        quotient = quotient * step + digit
    return 1 + whole * SCALE + quotient


class Tree(NamedTuple):
    """A K2-tree: per level a 4-bit mask for each kept quadrant, and where its first child is among those kept below."""

    masks: list[np.ndarray]
    first: list[np.ndarray]

    @staticmethod
    def build(row: np.ndarray, column: np.ndarray, height: int) -> tuple[Tree, np.ndarray]:
        """The tree of a square of side 2**height, and the order in which it holds the given cells (distinct)."""
        path = np.zeros(len(row), np.int64)  # quadrant numbers from the root down, two bits each
        for bit in range(height - 1, -1, -1):
            path = path << 2 | (row >> bit & 1) << 1 | column >> bit & 1
        order = np.argsort(path, kind="stable")
        masks, first, below = [], [], path[order]
        for _ in range(height):
            parents, start = np.unique(below >> 2, return_index=True)
            masks.append(np.bitwise_or.reduceat(1 << (below & 3), start).astype(np.uint8) if len(below) else np.empty(0, np.uint8))
            first.append(start)
            below = parents
        return Tree(masks[::-1], first[::-1]), order

    def child(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        """The kept child of each node of ``level``, -1 where that is empty; -1 has no children."""
        if not len(self.masks[level]):
            return np.full(len(node), -1)
        mask = self.masks[level][node]
        inside = (node >= 0) & (mask >> quadrant & 1).astype(bool)
        return np.where(inside, self.first[level][node] + np.bitwise_count(mask & ((1 << quadrant) - 1)), -1)


def pair_sums(row: np.ndarray, column: np.ndarray, value: np.ndarray, unseen: np.ndarray, columns: int, split: int) -> np.ndarray:
    """Sums over columns of |p - q| for every two rows a < b, by one joint walk of the tree.

    ``value`` are the cells held, ``unseen`` is each row's value elsewhere. With
    ``split`` only pairs of a row before it and one from it on are walked.
    """
    rows = len(unseen)
    height = max(rows - 1, columns - 1, 1).bit_length()
    tree, order = Tree.build(row, column, height)
    value = value[order]
    leaves = np.zeros(rows * rows, np.int64)
    sides = [(rows - 1 >> height - level) + 1 for level in range(height + 1)]  # of the rows, in quadrants
    empty = [np.zeros(n * n, np.int64) for n in sides]

    def add(to: np.ndarray, x: np.ndarray, y: np.ndarray, side: int, amount: np.ndarray) -> None:
        # Sums of at most NODES_AT_ONCE values up to about SCALE are exact in doubles.
        to += np.bincount(x * side + y, amount, len(to)).astype(np.int64)

    root = np.zeros(1, np.int64)
    held = root - (not len(row))
    work = [(0, [root, root, root, held, held])]  # level, rows a and b, column, their nodes
    while work:
        level, nodes = work.pop()
        if len(nodes[0]) > NODES_AT_ONCE // 8:
            step = NODES_AT_ONCE // 8
            work += [(level, [n[at : at + step] for n in nodes]) for at in range(0, len(nodes[0]), step)]
            continue
        a, b, c, node_a, node_b = nodes
        if level == height:
            p = np.where(node_a >= 0, value[node_a], unseen[a]) if len(value) else unseen[a]
            q = np.where(node_b >= 0, value[node_b], unseen[b]) if len(value) else unseen[b]
            add(leaves, a, b, rows, np.abs(p - q))
            continue
        side = height - level - 1  # of the children, as a power of two
        below = []
        for da, db, dc in product((0, 1), repeat=3):
            x, y, z = 2 * a + da, 2 * b + db, 2 * c + dc
            wanted = (x <= y) & (y << side < rows) & (z << side < columns)
            if side == 0:
                wanted &= x < y
            if split:
                wanted &= (x << side < split) & (y + 1 << side > split)
            x, y, z = x[wanted], y[wanted], z[wanted]
            in_a, in_b = tree.child(level, node_a[wanted], 2 * da + dc), tree.child(level, node_b[wanted], 2 * db + dc)
            none = (in_a < 0) & (in_b < 0)
            add(empty[level + 1], x[none], y[none], sides[level + 1], np.minimum(z[none] + 1 << side, columns) - (z[none] << side))
            some = ~none
            below.append([n[some] for n in (x, y, z, in_a, in_b)])
        found = [np.concatenate(n) for n in zip(*below)]
        if len(found[0]):
            work.append((level + 1, found))
    place = np.arange(rows)
    apart = np.zeros((rows, rows), np.int64)
    for level, (n, priced) in enumerate(zip(sides, empty)):
        own = place >> height - level
        apart += priced.reshape(n, n)[np.ix_(own, own)]
    return leaves.reshape(rows, rows) + apart * np.abs(unseen[:, None] - unseen[None, :])


PAIRS = "lang string, a int, b int, value bigint"


def _tile(cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Partial sums of all pairs of sources of two blocks, over the words of one tile."""
    groups = groups.sort_values("place")
    one, other = groups["one"].iloc[0], groups["other"].iloc[0]
    below = (groups["size"] + PRIOR * groups["v"]).to_numpy(np.int64)
    place = groups["place"].to_numpy(np.int64)
    split = 0 if one == other else int(np.searchsorted(place, other * BLOCK_SOURCES))
    row = np.searchsorted(place, cells["place"].to_numpy(np.int64))
    column, terms = pd.factorize(cells["term"])
    # Words of the same sources side by side, so that empty quadrants are large.
    least, most = np.full(len(terms), len(place)), np.full(len(terms), -1)
    np.minimum.at(least, column, row)
    np.maximum.at(most, column, row)
    at = np.empty(len(terms), np.int64)
    at[np.lexsort((most, least))] = np.arange(len(terms))
    value = probabilities(cells["n"].to_numpy(np.int64), below[row])
    unseen = probabilities(np.zeros(len(place), np.int64), np.maximum(below, 1))
    # Words of the tile that neither block holds are columns as well.
    sums = pair_sums(row, at[column], value, unseen, int(groups["words"].iloc[0]), split)
    a, b = np.triu_indices(len(place), 1)
    if split:
        a, b = a[(a < split) & (b >= split)], b[(a < split) & (b >= split)]
    return pd.DataFrame({"lang": groups["lang"].iloc[0], "a": place[a], "b": place[b], "value": sums[a, b]})


def _pairs(cells: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, a, b, value for every two sources (by place) of each language."""
    key = ["lang", "tile", "one", "other"]

    def with_blocks(rows: DataFrame) -> DataFrame:
        own = F.expr(f"place div {BLOCK_SOURCES}")
        met = rows.withColumn("_met", F.explode(F.expr(f"sequence(0, (sources - 1) div {BLOCK_SOURCES})")))
        return met.withColumns({"one": F.least(own, "_met").cast("int"), "other": F.greatest(own, "_met").cast("int")})

    tiles = F.expr(f"cast(greatest(1, ceil(v / {TILE_WORDS})) as int)")
    tile_of = F.pmod(F.xxhash64("term"), tiles).cast("int").alias("tile")
    left = with_blocks(cells.select("*", tile_of)).select(*key, "place", "term", "n")
    sizes = kept.select("lang", tile_of).groupBy("lang", "tile").agg(F.count(F.lit(1)).alias("words"))
    several = groups.where("sources > 1").withColumn("tile", F.explode(F.sequence(F.lit(0), tiles - 1)))
    several = several.join(sizes, ["lang", "tile"], "left").fillna(0, ["words"])
    right = with_blocks(several).select(*key, "place", "size", "v", "words")

    def tile(cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        if not len(groups):
            return pd.DataFrame({"lang": [], "a": [], "b": [], "value": []})
        return _tile(cells, groups)

    sums = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(tile, PAIRS)
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(
    docs: DataFrame, folder: str | None = None, kept_in: int = KEPT_IN, top_terms: int = TOP_TERMS
) -> DataFrame:
    """lang, source, part, item, value, rank of every source of every language.

    Part ``pair``: each other source of the language with the summed difference of
    the two in probability (times ``SCALE``) over the words kept. Part ``term``: the
    words that the source uses more than its language does. Both rank from 1, larger
    values first, then by item.

    Null text, lang and source count as empty ones, which are texts, languages and
    sources like others. A language that keeps no word gives pairs of value 0; an only
    source has no pairs. Rows that repeat count each time. Other columns are ignored,
    an empty table gives no row. A task holds the distinct words of one document, at
    most some ``HELD`` others, and a tile of the matrix.
    """
    folder = folder or shared_folder(docs.sparkSession, "source-divergence")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = rows.mapInArrow(_counted, COUNTED).groupBy("lang", "source", "term")
    counts = written(counted.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), f"{folder}/counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = written(kept.where(F.col("docs") >= kept_in).select("lang", "term", "total"), f"{folder}/kept")
    held = written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), f"{folder}/held")

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_size"))
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    in_order = Window.partitionBy("lang").orderBy("source")
    groups = groups.fillna(0, ["size", "v", "lang_size"]).withColumns(
        {"place": F.row_number().over(in_order) - 1, "sources": F.count(F.lit(1)).over(Window.partitionBy("lang")).cast("int")}
    )
    groups = written(groups, f"{folder}/groups")
    cells = held.join(groups, ["lang", "source"])

    again = groups.sparkSession.read.schema(groups.schema).parquet(f"{folder}/groups")  # apart from the one in cells
    # Salted, as all words of a language would meet in one task.
    salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sized = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    pairs = written(_pairs(cells, again, sized), f"{folder}/pairs")
    both = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select("lang", "place", "source")
    pair_rows = both.join(names.withColumnRenamed("place", "a"), ["lang", "a"]).join(
        names.select("lang", F.col("place").alias("b"), F.col("source").alias("item")), ["lang", "b"]
    )
    more = _probability("n", "size") - _probability("total", "lang_size")
    term_rows = cells.select("lang", "source", F.col("term").alias("item"), more.alias("value")).where("value > 0")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))

    def part(name: str, found: DataFrame) -> DataFrame:
        return found.select("lang", "source", F.lit(name).alias("part"), "item", "value", rank.alias("rank"))

    return part("pair", pair_rows).unionByName(part("term", term_rows).where(F.col("rank") <= top_terms))

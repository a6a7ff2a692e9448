"""Merkle manifest of a dataset: a leaf per row, a binary tree per group, a tree over the groups.

Rows of a group are numbered in order without ever meeting in one task: range
partitions number their own rows, and what a group has in the partitions before is
added. A superblock is an aligned run of leaves and as such a whole subtree; tasks
reduce superblocks to their roots, and those roots are the leaves of a table smaller
by that factor, until a group is one node, its subroot. The same is done once more
over the subroots.

On the way down, leaves meet the outer nodes that their superblock needs, its path to
the root, in a cogroup by superblock. There the task finishes the local reduction, joins
local and outer siblings to each leaf's proof, and folds the presented leaf up to a root.

A node is the SHA-256 of its children's digests end to end, all in lowercase hex; the
last node of a level has a single child if their number is odd.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from salesmart.llm.shared import shared_folder, with_fields, written

#: Levels of a superblock, which has 2**LEVELS leaves.
LEVELS = 10
DIGEST = 64  # characters


def digest(parts: str) -> str:
    return sha256(parts.encode()).hexdigest()


def tagged(value: Column) -> Column:
    """``-`` for null, else the value's number of UTF-8 bytes, ``:`` and the value, so that parts cannot be mistaken."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(tagged, values)), 256)


def height(leaves: int) -> int:
    """Levels above that many leaves."""
    return max(leaves - 1, 0).bit_length()


def levels_of(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the levels above them."""
    found = [nodes]
    for _ in range(levels):
        below = found[-1]
        found.append([digest("".join(below[at : at + 2])) for at in range(0, len(below), 2)])
    return found


def paths_of(levels: list[list[str]], proof: str, sides: str) -> tuple[list[str], list[str]]:
    """Proof and sides of each lowest node, given those of the top.

    A proof is the siblings' digests end to end, from the leaf up; ``sides`` says for
    each level where the sibling stands: L, R, or - if there is none.
    """
    proofs, marks = [proof], [sides]
    for nodes in levels[-2::-1]:
        own, at_side = [], []
        for at in range(len(nodes)):
            beside = at ^ 1
            held = beside < len(nodes)
            own.append((nodes[beside] if held else "") + proofs[at >> 1])
            at_side.append(("L" if at & 1 else "R" if held else "-") + marks[at >> 1])
        proofs, marks = own, at_side
    return proofs, marks


def fold(node: str, proof: str, sides: str) -> str:
    """The root that a leaf and its proof lead to."""
    at = 0
    for side in sides:
        sibling = "" if side == "-" else proof[at : at + DIGEST]
        at += len(sibling)
        node = digest(sibling + node if side == "L" else node + sibling)
    return node


def _run_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of each group of a sorted partition from 0."""
    last, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column("grp"))
        ends = runs.run_ends.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.append(0, ends[:-1])
        names = runs.values.to_pylist()
        places = np.arange(batch.num_rows) - np.repeat(starts, ends - starts)
        if names[0] == last:
            places[: ends[0]] += count
        last, count = names[-1], int(places[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], names=[*batch.schema.names, "at"])


def _numbered(rows: DataFrame, order: Sequence[str], folder: str) -> DataFrame:
    """Adds ``pos`` (from 0 in its ``grp``, by ``order``) and ``n`` (rows of the group)."""
    # Equal rows may fill several partitions: the last key tells them apart.
    keyed = written(rows, f"{folder}/rows").withColumn("_tie", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange("grp", *order, "_tie").sortWithinPartitions("grp", *order, "_tie").drop("_tie")
    dealt = dealt.withColumn("part", F.spark_partition_id())
    placed = written(dealt.mapInArrow(_run_places, with_fields(dealt, "at bigint")), f"{folder}/placed")
    counts = placed.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("grp").orderBy("part")) - F.col("_rows")
    counts = counts.withColumns({"_before": before, "n": F.sum("_rows").over(Window.partitionBy("grp"))})
    joined = placed.join(counts.drop("_rows"), ["grp", "part"])
    return joined.withColumn("pos", F.col("_before") + F.col("at")).drop("part", "at", "_before")


def _levels_in_block(n: int, levels: int) -> int:
    return levels if n > 1 << levels else height(n)


def _tiers(leaves: DataFrame, folder: str, levels: int) -> list[DataFrame]:
    """Tables (grp, pos, n, node): the leaves, the superblocks' roots, and so on up to one node per group."""

    def reduce_block(block: pd.DataFrame) -> pd.DataFrame:
        n = int(block["n"].iloc[0])
        nodes = block.sort_values("pos")["node"].tolist()
        top = levels_of(nodes, _levels_in_block(n, levels))[-1]
        above = {"pos": block["pos"].iloc[0] >> levels, "n": -(-n >> levels), "node": top}
        return pd.DataFrame({"grp": block["grp"].iloc[0], **above})

    def most(tier: DataFrame) -> int:
        return tier.agg(F.max("n").alias("n")).first()["n"] or 0

    tiers = [leaves]
    while len(tiers) == 1 or most(tiers[-1]) > 1:
        nodes = tiers[-1].select("grp", "pos", "n", "node").groupBy("grp", F.shiftright("pos", levels).alias("block"))
        above = nodes.applyInPandas(reduce_block, "grp string, pos bigint, n bigint, node string")
        tiers.append(written(above, f"{folder}/tier-{len(tiers)}"))
    return tiers


OUTER = "subroot string, root string, proof string, sides string"


def _with_outer(nodes: DataFrame, outer: DataFrame, levels: int, fields: str, finish) -> DataFrame:
    """Cogroups nodes with the outer row of their superblock; ``finish`` gets both and the paths of the nodes."""
    block = F.shiftright("pos", levels).alias("block")

    def join(block: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        own = levels_of(block["node"].tolist(), _levels_in_block(int(block["n"].iloc[0]), levels))
        proofs, sides = paths_of(own, above["proof"].iloc[0], above["sides"].iloc[0])
        found = block.assign(proof=proofs, sides=sides, subroot=above["subroot"].iloc[0], root=above["root"].iloc[0])
        return finish(found)

    above = outer.select("grp", F.col("pos").alias("block"), *(f.split()[0] for f in OUTER.split(", ")))
    cogrouped = nodes.groupBy("grp", block).cogroup(above.groupBy("grp", "block"))
    return cogrouped.applyInPandas(join, fields)


def _paths(tiers: list[DataFrame], top: DataFrame, folder: str, levels: int) -> DataFrame:
    """The outer rows of the lowest tier's superblocks, from those of the top nodes (grp, pos, OUTER)."""
    outer = top
    for number in range(len(tiers) - 2, 0, -1):
        fields = f"grp string, pos bigint, {OUTER}"
        names = [f.split()[0] for f in fields.split(", ")]
        outer = written(
            _with_outer(tiers[number], outer, levels, fields, lambda found, names=names: found[names]), f"{folder}/outer-{number}"
        )
    return outer


def manifest(
    docs: DataFrame,
    values: Sequence[str],
    order: str,
    group: str,
    folder: str | None = None,
    presented: Mapping[str, Column] | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """Per row: ``order`` column, leaf, subroot, root, proof, sides, folded_root, verified.

    A leaf is the digest of the row's ``values``. Leaves ascend by ``order`` within their
    ``group`` (nulls first, equal ones by leaf), groups by name (null first, bytewise).
    ``presented`` gives columns other values for the rows that are checked against the
    manifest: ``folded_root`` is what such a row and its proof lead to, and is the root
    only for a row that was not changed. Rows with null keys and repeated rows are leaves
    like others; other columns are ignored; an empty table gives no row and has no root.
    """
    folder = folder or shared_folder(docs.sparkSession, "merkle-manifest")
    changed = dict(presented or {})
    original = leaf([F.col(v) for v in values])
    other = leaf([changed.get(v, F.col(v)) for v in values])
    differs = [~changed[v].eqNullSafe(F.col(v)) for v in values if v in changed]
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("grp"),
        F.col(order).alias("key"),
        original.alias("node"),
        (F.when(F.array_max(F.array(*differs)), other) if differs else F.lit(None).cast("string")).alias("other"),
    )
    leaves = written(_numbered(rows, ["key", "node"], f"{folder}/leaves"), f"{folder}/tier-0")
    tiers = _tiers(leaves, folder, levels)

    subroots = tiers[-1].select(F.lit("").alias("grp"), F.col("grp").alias("of"), "node")
    of_groups = written(_numbered(subroots, ["of"], f"{folder}/groups"), f"{folder}/groups/tier-0")
    upper = _tiers(of_groups, f"{folder}/groups", levels)
    nothing = [F.lit("").alias("proof"), F.lit("").alias("sides")]
    top = upper[-1].select("grp", "pos", F.lit("").alias("subroot"), F.col("node").alias("root"), *nothing)
    outer = _paths(upper, top, f"{folder}/groups", levels)

    def of_group(found: pd.DataFrame) -> pd.DataFrame:
        return found.assign(grp=found["of"], pos=0, subroot=found["node"])[["grp", "pos", "subroot", "root", "proof", "sides"]]

    group_paths = written(_with_outer(of_groups, outer, levels, f"grp string, pos bigint, {OUTER}", of_group), f"{folder}/group-paths")
    outer = _paths(tiers, group_paths, folder, levels)

    def of_leaf(found: pd.DataFrame) -> pd.DataFrame:
        given = found["other"].where(found["other"].notna(), found["node"])
        folded = [fold(*one) for one in zip(given, found["proof"], found["sides"])]
        found = found.assign(folded_root=folded, verified=[f == r for f, r in zip(folded, found["root"])], leaf=found["node"])
        return found[["key", "leaf", "subroot", "root", "proof", "sides", "folded_root", "verified"]]

    kind = docs.select(F.col(order)).schema[0].dataType.simpleString()
    fields = f"key {kind}, leaf string, subroot string, root string, proof string, sides string, folded_root string, verified boolean"
    return _with_outer(leaves, outer, levels, fields, of_leaf).withColumnRenamed("key", order)


def manifest_digests(docs: DataFrame, folder: str | None = None, levels: int = LEVELS) -> DataFrame:
    """The manifest of documents by language, each row presented with a change where its doc_id says so.

    Where 7 divides the CRC-32 of doc_id, n_chars is presented one higher; a null
    doc_id is never changed, and a null n_chars stays one.
    """
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    counted = F.col("n_chars").cast("decimal(20,0)")
    presented = {"n_chars": F.when(F.coalesce(tampered, F.lit(False)), counted + 1).otherwise(counted).cast("string")}
    values = ["doc_id", "source", "lang", "n_chars", "text"]
    found = manifest(docs, values, "doc_id", "lang", folder, presented, levels)
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof"), 256).alias("proof_sha256"), "folded_root", "verified"
    )

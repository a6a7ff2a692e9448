"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.shared import written


def _both_ways(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.select("a", "b").unionByName(back)


def _least(neighbours: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself, counted map-side before the join that uses it."""
    return neighbours.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest one."""
    around = _both_ways(edges)
    linked = around.join(_least(around), "a").where("b > a")
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    others = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (bigint a, b).

    Each round is a table below ``folder``, so nothing is recomputed from far back;
    the number of rounds grows with the logarithm of a component's diameter.
    """
    current = written(edges.where("a <> b").selectExpr("a", "b").distinct(), f"{folder}/round-0")
    before, number = None, 0
    while True:
        state = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before or state["n"] == 0:
            break
        before, number = state, number + 1
        step = _small_star(_large_star(current)).where("a <> b").distinct()
        current = written(step, f"{folder}/round-{number}")
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

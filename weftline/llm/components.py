"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node points its greater neighbours at its least one. Edges have u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node points its smaller neighbours, and itself, at the least of them."""
    least = _least_neighbour(edges)
    lower = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node of its component.

    edges: (u, v), any order, repeats and loops allowed, no nulls. Rounds run until the table no longer
    changes, O(log^2) of the nodes at worst. Minima are pre-aggregated and joined with one row a node,
    so that a node with many neighbours is a skewed join that Spark splits. Each round is a written table.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = scratch.put(edges, f"{name}-0")
    before, turn = None, 0
    state = _state(now)
    while state != before:
        before, turn = state, turn + 1
        now = scratch.put(_small_star(_large_star(now)), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        state = _state(now)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

"""Connected components by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Shelf


def _star(edges: DataFrame, large: bool, shelf: Shelf, name: str) -> DataFrame:
    """One star step: neighbours of each node are linked to the smallest of them.

    `edges` has one direction, a > b. The large star keeps the larger neighbours of both
    directions, the small star the smaller. A node with many neighbours moves as partial
    minima; these are stored, so that the join back deals out both sides anew and adaptive
    execution can split it.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = shelf.put(least, name)
    joined = both.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    moved = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.where("a > m").select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, shelf: Shelf, label: str) -> DataFrame:
    """(node, component) of every node of `edges` (a, b); the component is its smallest node.

    Self-links and nulls are left out; an empty table gives an empty result.
    """
    at = shelf.put(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}0")
    before, step = None, 0
    while True:
        # Large then small star; stops when the set of links no longer changes.
        sums = at.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("a", "b") % 1000003).alias("s")).first()
        if tuple(sums) == before or sums["n"] == 0:
            break
        before, step = tuple(sums), step + 1
        wide = shelf.put(_star(at, True, shelf, f"{label}{step}l"), f"{label}{step}w")
        at = shelf.put(_star(wide, False, shelf, f"{label}{step}s"), f"{label}{step}")
        shelf.drop(f"{label}{step - 1}", f"{label}{step}l", f"{label}{step}w", f"{label}{step}s")
    nodes = at.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def large_star(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on the least of its neighbourhood."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node hangs itself and its smaller neighbours on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 100) -> DataFrame:
    """node, component (least node of its component) of all nodes that have an edge but that least one; edges: u, v (any order).

    A node with very many neighbours costs no more than its edges: minima are summed up within tasks first, and its edges are
    joined to one row. Each round is written to the shared folder.
    """
    edges = scratch.save(edges.select("u", "v").filter("u <> v").distinct(), f"{name}-0")
    mark, last = _mark(edges), f"{name}-0"
    for i in range(1, rounds + 1):
        edges = scratch.save(small_star(large_star(edges)), f"{name}-{i}")
        scratch.drop(last)
        new, last = _mark(edges), f"{name}-{i}"
        if new == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = new
    raise RuntimeError(f"components have not settled after {rounds} rounds")

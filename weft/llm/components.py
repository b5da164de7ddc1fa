"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.scratch import Scratch


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(node, component): of each node with a link, the least node that it reaches. Links are (a, b) in any order.

    Alternating large and small stars: each round links a node's neighbours to the least of them, first the greater
    ones, then the others. Every round is a written table; the driver sees a count and a checksum. Minima are summed
    up before the shuffle, and a hub's links are rows, not a list."""
    edge = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edge = scratch.table(edge, f"{name}0")
    state, k = _state(edge), 0
    while state[0]:
        both = edge.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edge.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        large = scratch.table(large, f"{name}{k}l")
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).filter("x < y")
        small = small.unionByName(down.select(F.col("m").alias("x"), F.col("b").alias("y"))).distinct().select(F.col("x").alias("a"), F.col("y").alias("b"))
        k += 1
        new = scratch.table(small, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        scratch.drop(f"{name}{k - 1}l")
        edge, before, state = new, state, _state(new)
        if state == before:
            break
    roots = edge.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edge.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)

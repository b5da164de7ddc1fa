"""Breadth-first traversals. Each level is one join of the frontier with the edges and one anti-join with what has been
seen; its result is checkpointed, so plans don't grow with depth and lost executors don't replay earlier levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators.search import checked, first_node
from weft.plans.lineage import cut, numbered

RELATED_LIMIT = 50


def neighbours(edges: DataFrame, direction: str, kinds: Sequence[str] | None = None) -> DataFrame:
    """(here, there, edge_type, way, edge_ord) along 'out', 'in' or 'both'."""
    held = edges.filter(F.col("type").isin(*kinds)) if kinds is not None else edges
    out = held.select(F.col("src").alias("here"), F.col("dst").alias("there"), F.col("type").alias("edge_type"), F.lit("out").alias("way"), F.col("ord").alias("edge_ord"))
    into = held.select(F.col("dst").alias("here"), F.col("src").alias("there"), F.col("type").alias("edge_type"), F.lit("in").alias("way"), F.col("ord").alias("edge_ord"))
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction is out, in or both, not {direction!r}")
    return out if direction == "out" else into if direction == "in" else out.unionByName(into)


def levels(edges: DataFrame, start: DataFrame, depth: int, direction: str, kinds: Sequence[str] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(id, depth) of what is reached from start (id) within `depth` steps, start included at 0.

    A reached node outside `allowed` (id) is neither returned nor expanded nor looked at again."""
    steps = neighbours(edges, direction, kinds).select("here", "there")
    frontier = cut(start.select("id").distinct())
    seen, found = frontier, frontier.withColumn("depth", F.lit(0))
    for d in range(1, checked(depth) + 1):
        reached = frontier.join(steps, frontier["id"] == steps["here"]).select(F.col("there").alias("id")).distinct().join(seen, "id", "left_anti")
        reached = cut(reached)
        if reached.isEmpty():
            break
        seen = seen.unionByName(reached)
        frontier = reached if allowed is None else cut(reached.join(allowed, "id", "left_semi"))
        found = found.unionByName(frontier.withColumn("depth", F.lit(d)))
    return found


def dependencies(nodes: DataFrame, edges: DataFrame, path: str, depth: int = 1, repo: str | None = None, dependents: bool = False) -> DataFrame:
    """path, language, depth of the files that a file imports, or that import it, at their least depth."""
    files = nodes.filter(F.col("type") == "File")
    files = files.filter(F.col("repo") == repo) if repo else files
    start = files.filter(F.col("path") == path).select("id")
    found = levels(edges, start, depth, "in" if dependents else "out", ["IMPORTS"], files.select("id"))
    return found.filter("depth > 0").join(files.select("id", "path", "language"), "id").select("path", "language", "depth")


def call_graph(nodes: DataFrame, edges: DataFrame, function: str, depth: int = 2, direction: str = "both", repo: str | None = None) -> DataFrame:
    """caller, callee (qualified names): the calls at functions less than `depth` steps away, each once."""
    ways = {"callers": "in", "callees": "out", "both": "both"}
    start = first_node(nodes, function, ["Function"], repo).select("id")
    calls = edges.filter(F.col("type") == "CALLS")
    if checked(depth) == 0:
        held = start.filter("false")
    else:
        held = levels(calls, start, depth - 1, ways[direction]).select("id")
    parts = []
    if direction in ("callees", "both"):
        parts.append(calls.join(held.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst"))
    if direction in ("callers", "both"):
        parts.append(calls.join(held.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst"))
    pairs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    label = nodes.select("id", F.coalesce("qualified_name", "name").alias("label"))
    return pairs.distinct().join(label.select(F.col("id").alias("src"), F.col("label").alias("caller")), "src").join(label.select(F.col("id").alias("dst"), F.col("label").alias("callee")), "dst").select("caller", "callee")


def find_related(nodes: DataFrame, edges: DataFrame, name: str, hops: int = 2, repo: str | None = None, limit: int = RELATED_LIMIT) -> DataFrame:
    """type, name, qualified_name, distance over edges of all types, either way; the nearest fifty, then by name."""
    start = first_node(nodes, name, repo=repo).select("id")
    found = levels(edges, start, hops, "both").filter("depth > 0")
    near = found.join(nodes.select("id", "type", "name", "qualified_name", "ord"), "id")
    # Both tie rules: collation first, then the order of insertion.
    ordered = near.orderBy("depth", F.collate(F.col("name"), "UNICODE"), "ord").limit(limit)
    return ordered.select("type", "name", F.coalesce("qualified_name", F.lit("")).alias("qualified_name"), F.col("depth").alias("distance"))


def run_traversal(nodes: DataFrame, edges: DataFrame, start: str, kinds: Sequence[str] | None = None, direction: str = "both", depth: int = 2) -> DataFrame:
    """id, type, name, edge_type, direction, depth of the nodes reached, each by the first edge that reaches it: by the
    order of the node before, then 'in' before 'out', then by the edge's."""
    first = first_node(nodes, start, by_path=True).select("id")
    steps = neighbours(edges, direction, kinds)
    frontier = cut(first.withColumn("rank", F.lit(0).cast("bigint")))
    seen, found = frontier.select("id"), None
    for d in range(1, checked(depth) + 1):
        reached = frontier.join(steps, frontier["id"] == steps["here"]).select(F.col("there").alias("id"), "edge_type", "way", F.struct("rank", "way", "edge_ord").alias("by")).join(seen, "id", "left_anti")
        best = reached.groupBy("id").agg(F.min(F.struct("by", "edge_type")).alias("m")).select("id", F.col("m.edge_type").alias("edge_type"), F.col("m.by.way").alias("direction"), F.col("m.by").alias("by"))
        best = cut(best)
        if best.isEmpty():
            break
        found_now = best.select("id", "edge_type", "direction", F.lit(d).alias("depth"))
        found = found_now if found is None else found.unionByName(found_now)
        seen = seen.unionByName(best.select("id"))
        if d < depth:
            # The next level's order is that in which this one was reached.
            order = best.select("id", F.col("by.rank").alias("before"), F.col("by.way").alias("way"), F.col("by.edge_ord").alias("edge_ord"))
            frontier = cut(numbered(order, "rank", "before", "way", "edge_ord", "id").select("id", "rank"))
    if found is None:
        found = seen.filter("false").select("id", F.lit("").alias("edge_type"), F.lit("").alias("direction"), F.lit(0).alias("depth"))
    about = nodes.select("id", F.col("type").alias("type"), "name", "qualified_name")
    return found.join(about, "id").select("id", "type", "name", "qualified_name", "edge_type", "direction", "depth")


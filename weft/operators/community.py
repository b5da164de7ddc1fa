"""Communities: the weighted projection, Louvain, members, parents and reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.plans.lineage import cut, numbered
from weft.schema import COMMUNITY_EDGES, EDGES, NODES, PHASE, PHASES

#: Edge weights by type (others 1), and the resolution of each level.
WEIGHTS = {"CALLS": 3.0, "IMPORTS": 2.0, "HAS_METHOD": 2.0, "EXTENDS": 2.0, "CONTAINS": 1.0, "IMPORTS_EXTERNAL": 0.5}
RESOLUTIONS = (0.5, 1.0, 2.0)
#: Links (two a pair) of a graph that one task finishes, at most; and the gain in modularity below which a sweep is the last of its level.
BLOCK, GAIN = 100_000, 1e-3


def projection(edges: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: of the edges between two nodes, either way, the first one's weight."""
    kept = edges.filter(~F.col("type").isin(*COMMUNITY_EDGES) & (F.col("src") != F.col("dst")))
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p]), F.col("type")), F.lit(1.0))
    return kept.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min_by(weight, F.col("ord")).alias("weight"))


def _moves(order: list, links: dict, at: dict, degree: dict, held: dict, resolution: float, total: float) -> bool:
    """Local moves of nodes, in order, until none gains, among their neighbours' communities `at`; whether any moved. Of
    equal gains the least community wins, and a node stays unless it gains."""
    ever, moved = False, True
    while moved:
        moved = False
        for v in order:
            near: dict = {}
            for u, w in links[v].items():
                near[at[u]] = near.get(at[u], 0.0) + w
            c, rate, margin = at[v], resolution * degree[v] / total, 1e-10 * (1 + degree[v])
            held[c] -= degree[v]
            best, most = c, near.get(c, 0.0) - rate * held[c]
            for x in sorted(near):
                gain = near[x] - rate * held[x]
                if gain > most + margin:
                    best, most = x, gain
            held[best] += degree[v]
            if best != c:
                at[v], moved, ever = best, True, True
    return ever


def _levels(links: dict, degree: dict, resolution: float) -> dict:
    """Node -> label (its least member): local moves, then communities become nodes, until nothing moves."""
    label, total = {v: v for v in degree}, sum(degree.values())
    while total:
        at = {v: v for v in degree}
        if not _moves(sorted(degree), links, at, degree, dict(degree), resolution, total):
            break
        names: dict = {}
        for v in sorted(degree):
            names.setdefault(at[v], v)
        merged: dict = {n: {} for n in names.values()}
        sums = dict.fromkeys(merged, 0.0)
        for v, near in links.items():
            x = names[at[v]]
            sums[x] += degree[v]
            for u, w in near.items():
                y = names[at[u]]
                if x != y:
                    merged[x][y] = merged[x].get(y, 0.0) + w
        label = {v: names[at[c]] for v, c in label.items()}
        links, degree = merged, sums
    return label


def louvain(pairs: Iterable[tuple], resolution: float = 1.0) -> dict:
    """Node -> label (its least member) of a graph that fits one task."""
    links: dict = {}
    for a, b, w in pairs:
        links.setdefault(a, {})[b] = links.setdefault(a, {}).get(b, 0.0) + w
        links.setdefault(b, {})[a] = links.setdefault(b, {}).get(a, 0.0) + w
    return _levels(links, {v: sum(near.values()) for v, near in links.items()}, resolution)


def modularity(pairs: Iterable[tuple], label: dict, resolution: float = 1.0) -> float:
    total, inside, degree = 0.0, 0.0, {}
    for a, b, w in pairs:
        total += w
        inside += w if label[a] == label[b] else 0.0
        degree[label[a]] = degree.get(label[a], 0.0) + w
        degree[label[b]] = degree.get(label[b], 0.0) + w
    return inside / total - resolution * sum((d / (2 * total)) ** 2 for d in degree.values()) if total else 0.0


def _of(df: pd.DataFrame, node: bool):
    """(v, c, w) of a block's nodes, or of its links."""
    kept = df[df["node"].to_numpy() == node]
    return zip(*[kept[c].to_numpy().tolist() for c in "vcw"], strict=True)


def _finished(df: pd.DataFrame, resolution: float) -> pd.DataFrame:
    """All remaining levels of a graph of one block."""
    degree = {v: k for v, _, k in _of(df, True)}
    links: dict = {v: {} for v in degree}
    for v, u, w in _of(df, False):
        links[v][u] = w
    found = _levels(links, degree, resolution)
    return pd.DataFrame({"v": list(found), "c": list(found.values())}, columns=["v", "c"])


def _rows(df: DataFrame, block: Column, node: bool, v: str, c: str, w: str) -> DataFrame:
    return df.select(block.alias("block"), F.lit(node).alias("node"), F.col(v).alias("v"), F.col(c).alias("c"), F.col(w).alias("w"))


def _turn(links: DataFrame, label: DataFrame, total: float, resolution: float, moves: Column) -> DataFrame:
    """label (v, c, k) after the nodes that `moves` names went where they gain most, as communities are at its start. Of
    equal gains the least community wins, and a node stays unless it gains. links: (v, u, weight, k), k the degree of v."""
    at = label.join(label.groupBy("c").agg(F.sum("k").alias("held")), "c")
    near = links.filter(moves).join(at.select(F.col("v").alias("u"), "c", "held"), "u").select("v", "c", "k", "held", "weight", F.lit(False).alias("own"))
    stays = at.select("v", "c", "k", "held", F.lit(0.0).alias("weight"), F.lit(True).alias("own"))  # of all: those that don't move have no other row
    each = near.unionByName(stays).groupBy("v", "c").agg(F.max("k").alias("k"), F.max("held").alias("held"), F.sum("weight").alias("w"), F.max("own").alias("own"))
    worth = F.col("w") - resolution * F.col("k") * (F.col("held") - F.when(F.col("own"), F.col("k")).otherwise(0.0)) / total
    rated = each.select("v", "c", "k", "own", worth.alias("worth"))
    other = F.max(F.when(~F.col("own"), F.struct("worth", (-F.col("c")).alias("back"))))
    best = rated.groupBy("v").agg(F.max("k").alias("k"), F.max(F.when(F.col("own"), F.col("c"))).alias("at"), F.max(F.when(F.col("own"), F.col("worth"))).alias("stay"), other.alias("other"))
    gains = F.col("other.worth") > F.col("stay") + 1e-10 * (1 + F.col("k"))
    return best.select("v", F.when(gains, -F.col("other.back")).otherwise(F.col("at")).alias("c"), "k")


def _worth(links: DataFrame, label: DataFrame, total: float, resolution: float) -> float:
    """Modularity of label, but for what is inside nodes."""
    a, b = label.select("v", F.col("c").alias("vc")), label.select(F.col("v").alias("u"), F.col("c").alias("uc"))
    inside = links.filter("v < u").join(a, "v").join(b, "u").filter("vc = uc").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("inside"))
    chance = label.groupBy("c").agg((F.sum("k") / total).alias("share")).agg(F.sum(F.col("share") * F.col("share")).alias("chance"))
    one = inside.crossJoin(chance).first()  # one row each
    return 2 * one["inside"] / total - resolution * one["chance"]


def _local(links: DataFrame, degree: DataFrame, total: float, resolution: float, parts: int) -> tuple[DataFrame, float]:
    """(v, c), and the gain in modularity: communities after local moves. links: (v, u, weight, k) both ways; degree: (v, k),
    with what is inside nodes.

    A sweep deals the nodes to turns by a hash, and in its turn each node moves once, at the same time as the turn's others.
    As these can't see each other's moves, modularity is measured after each sweep. A sweep that lowers it is undone, and
    from then on there are twice as many turns; so modularity never falls. Labels are written in `parts` parts at most."""
    label, gained, sweep, turns = cut(degree.select("v", F.col("v").alias("c"), "k")), 0.0, 0, 2
    worth = _worth(links, label, total, resolution)
    while True:
        moved = label
        for turn in range(turns):
            moved = cut(_turn(links, moved, total, resolution, F.pmod(F.xxhash64(F.col("v"), F.lit(sweep)), F.lit(turns)) == turn).coalesce(parts))
        gain, sweep = _worth(links, moved, total, resolution) - worth, sweep + 1
        if gain < -1e-12:
            turns *= 2
            continue
        label, worth, gained = moved, worth + gain, gained + gain
        if gain <= GAIN:
            return label.select("v", "c"), gained


def labelled(pairs: DataFrame, resolution: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(node_id, label) of the nodes of pairs (a, b, weight): local moves, then communities become nodes, until nothing
    moves. A label is its community's least node. Once what is left is one block, a task goes through all levels that
    remain; of a graph of many blocks, a level that gains less than a sweep must, and leaves most nodes, is the last."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node_id")).distinct()
    ids = cut(numbered(ends, "v", "node_id").select("node_id", F.col("v").cast("bigint").alias("v")))  # in the nodes' order
    a, b = ids.select(F.col("node_id").alias("a"), "v"), ids.select(F.col("node_id").alias("b"), F.col("v").alias("u"))
    once = cut(pairs.join(a, "a").join(b, "b").select("v", "u", F.col("weight").cast("double").alias("weight")))
    links = once.unionByName(once.select(F.col("u").alias("v"), F.col("v").alias("u"), "weight"))
    degree = links.groupBy("v").agg(F.sum("weight").alias("k"))
    labels, last = None, False
    while True:
        blocks = -(-links.count() // block)
        if blocks <= 1:
            one = _rows(degree, F.lit(0), True, "v", "v", "k").unionByName(_rows(links, F.lit(0), False, "v", "u", "weight"))
            moved = one.groupBy("block").applyInPandas(lambda df: _finished(df, resolution), "v bigint, c bigint")
        else:
            degree = cut(degree.coalesce(blocks))
            links = cut(links.join(degree, "v").select("v", "u", "weight", "k").coalesce(blocks))
            moved, gain = _local(links, degree, degree.agg(F.sum("k").alias("t")).first()["t"], resolution, blocks)
            # Merged nodes are called by their least member.
            names = moved.groupBy("c").agg(F.min("v").alias("name"))
            moved = cut(moved.join(names, "c").select("v", F.col("name").alias("c")))
            left, all_ = moved.agg(F.count_if(F.col("v") == F.col("c")), F.count("*")).first()
            last = left == all_ or gain <= GAIN and 2 * left > all_
        own = moved.select(F.col("v").alias("n"), F.col("c").alias("label"))
        labels = own if labels is None else labels.join(moved, F.col("label") == F.col("v")).select("n", F.col("c").alias("label"))
        if blocks <= 1 or last:
            named = labels.join(ids.select(F.col("v").alias("n"), "node_id"), "n")
            return named.join(ids.select(F.col("v").alias("label"), F.col("node_id").alias("name")), "label").select("node_id", F.col("name").alias("label"))
        labels = cut(labels)
        there = moved.select(F.col("v").alias("u"), F.col("c").alias("d"))
        links = cut(links.join(moved, "v").join(there, "u").filter("c <> d").groupBy(F.col("c").alias("v"), F.col("d").alias("u")).agg(F.sum("weight").alias("weight")))
        degree = degree.join(moved, "v").groupBy(F.col("c").alias("v")).agg(F.sum("k").alias("k"))


def partition(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(node_id, label) of all nodes but communities; nodes without edges are communities of their own."""
    labels = labelled(cut(projection(edges)), resolution, block)
    held = nodes.filter(F.col("type") != "Community").select(F.col("id").alias("node_id")).distinct()
    return held.join(labels, "node_id", "left").select("node_id", F.coalesce("label", "node_id").alias("label"))


def quality(pairs: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of (node_id, label) over pairs (a, b, weight)."""
    a, b = (labels.select(F.col("node_id").alias(x), F.col("label").alias(f"{x}_label")) for x in "ab")
    known = cut(pairs.join(a, "a").join(b, "b").select("a_label", "b_label", "weight"))
    total, inside = known.agg(F.sum("weight"), F.sum(F.when(F.col("a_label") == F.col("b_label"), F.col("weight")).otherwise(0.0))).first()
    if not total:
        return 0.0
    ends = known.select(F.explode(F.array("a_label", "b_label")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("d"))
    return inside / total - resolution * ends.agg(F.sum((F.col("d") / (2 * total)) ** 2)).first()[0]


def named(labels: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """MEMBERSHIP rows with names 'level{L}_community{N}', numbered by each community's first node."""
    order = nodes.groupBy(F.col("id").alias("node_id")).agg(F.min("ord").alias("ord"))
    first = labels.join(order, "node_id").groupBy("label").agg(F.min("ord").alias("first"))
    ids = numbered(first, "n", "first", "label").select("label", F.concat(F.lit(f"level{level}_community"), F.col("n").cast("string")).alias("name"))
    return labels.join(ids, "label").select("node_id", F.lit(level).alias("level"), F.concat(F.lit("Community::"), "name").alias("community_id"))


def sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("level", "community_id").agg(F.count("*").alias("member_count"))


def parents(membership: DataFrame, first_ord: DataFrame | None = None) -> DataFrame:
    """(level, child, parent): of each community of a level the one of the next with which it shares most members, of
    equals the first by name (or by first_ord: community_id, ord)."""
    below = membership.select("node_id", "level", F.col("community_id").alias("child"))
    above = membership.select("node_id", (F.col("level") - 1).alias("level"), F.col("community_id").alias("parent"))
    shared = below.join(above, ["node_id", "level"]).groupBy("level", "child", "parent").agg(F.count("*").alias("n"))
    if first_ord is not None:
        shared = shared.join(first_ord.select(F.col("community_id").alias("parent"), "ord"), "parent", "left")
        best = F.min_by("parent", F.struct(-F.col("n"), "ord", "parent"))
    else:
        best = F.min_by("parent", F.struct(-F.col("n"), "parent"))
    return shared.groupBy("level", "child").agg(best.alias("parent"), F.max("n").alias("overlap"))


def level_report(membership: DataFrame) -> DataFrame:
    return sizes(membership).groupBy("level").agg(F.count("*").alias("communities"), F.sum("member_count").alias("members"))


def detect(nodes: DataFrame, edges: DataFrame, resolutions: Sequence[float] = RESOLUTIONS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, membership) with communities at every level in place of old ones; communityId is level 1's."""
    base = nodes.filter(F.col("type") != "Community")
    plain = edges.filter(~F.col("type").isin(*COMMUNITY_EDGES))
    membership = None
    for level, resolution in enumerate(resolutions):
        one = cut(named(partition(base, plain, resolution), base, level))
        membership = one if membership is None else membership.unionByName(one)
    counted = sizes(membership)
    number = F.regexp_extract("community_id", r"(\d+)$", 1).cast("bigint")
    own = counted.select(*[{
        "id": F.col("community_id"), "type": F.lit("Community"), "name": F.regexp_replace("community_id", "^Community::", ""), "repo": F.lit(""),
        "level": F.col("level"), "member_count": F.col("member_count"), "ord": F.lit(PHASES["Community"]).cast("bigint") * PHASE + F.col("level").cast("bigint") * (PHASE // 100) + number,
    }.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in NODES.fields])
    middle = membership.filter("level = 1").select(F.col("node_id").alias("id"), F.col("community_id").alias("__c"))
    marked = base.join(middle, "id", "left").withColumn("community_id", F.regexp_replace("__c", "^Community::", "")).select(NODES.fieldNames())
    up = parents(membership, own.select(F.col("id").alias("community_id"), "ord"))
    edge = lambda df, kind, src, dst, phase: df.select(*[{
        "src": F.col(src), "dst": F.col(dst), "type": F.lit(kind), "repo": F.lit(""), "ord": F.lit(phase).cast("bigint") * PHASE,
    }.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in EDGES.fields])
    belongs = edge(membership, "BELONGS_TO_COMMUNITY", "node_id", "community_id", 7)
    above = edge(up, "PARENT_COMMUNITY", "child", "parent", 8)
    return marked.unionByName(own), plain.unionByName(belongs).unionByName(above), membership



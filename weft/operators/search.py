"""Point queries, ranked search and summaries over nodes and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.scalars import path_of
from weft.schema import COMMUNITY_EDGES

SEARCHED = ("Function", "Class", "Interface", "Variable", "File", "Module")
LISTED = ("Function", "Class", "Interface", "Variable")
SEARCH_LIMIT, NODES_LIMIT, GRAPH_LIMIT, COMMUNITIES_LIMIT, SAMPLE = 20, 20, 500, 20, 10
PALETTE = 20
#: Lines are whole numbers of 32 bits, and so a span has fewer than 2**33.
LEVELS = 32


def checked(limit: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 0:
        raise ValueError(f"a whole number from 0 on is needed, not {limit!r}")
    return limit


def score(name: Column, qualified_name: Column, pattern: str) -> Column:
    """10 for the name itself, 7 for its beginning, 5 for any part, 3 for a part of the qualified name; else null."""
    p = F.lit(pattern.lower())
    name, qualified = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(qualified_name, F.lit("")))
    return F.when(name == p, 10).when(name.startswith(p), 7).when(name.contains(p), 5).when(qualified.contains(p), 3)


def _ranked(nodes: DataFrame, pattern: str, kinds: Sequence[str], limit: int) -> DataFrame:
    found = nodes.filter(F.col("type").isin(*kinds)).withColumn("score", score(F.col("name"), F.col("qualified_name"), pattern))
    return found.filter("score IS NOT NULL").orderBy(F.desc("score"), "ord").limit(checked(limit))


def search_by_name(nodes: DataFrame, pattern: str, kind: str | None = None, limit: int = SEARCH_LIMIT, repo: str | None = None) -> DataFrame:
    """type, name, qualified_name, score: the best matches of a literal pattern, ties by ord."""
    held = nodes.filter(F.col("repo") == repo) if repo else nodes
    kinds = [k for k in SEARCHED if kind is None or k == kind]
    if not kinds:
        return held.filter("false").select("type", "name", "qualified_name", F.lit(0).alias("score"))
    return _ranked(held, pattern, kinds, limit).select("type", "name", F.coalesce("qualified_name", F.lit("")).alias("qualified_name"), "score")


def search_nodes(nodes: DataFrame, query: str) -> DataFrame:
    """id, type, name, qualified_name, score for the viewer: 20 rows, none for a blank query."""
    held = nodes if query.strip() else nodes.filter("false")
    return _ranked(held, query.strip(), LISTED, NODES_LIMIT).select("id", "type", "name", F.coalesce("qualified_name", F.lit("")).alias("qualified_name"), "score")


def first_node(nodes: DataFrame, name: str, kinds: Sequence[str] | None = None, repo: str | None = None, by_path: bool = False) -> DataFrame:
    """The first node in ord with this name or qualified name (or path)."""
    same = (F.col("name") == name) | (F.col("qualified_name") == name)
    if by_path:
        same = same | (F.col("path") == name)
    found = nodes.filter(same)
    if kinds:
        found = found.filter(F.col("type").isin(*kinds))
    if repo:
        found = found.filter(F.col("repo") == repo)
    return found.orderBy("ord").limit(1)


def highlight_by_name(nodes: DataFrame, name: str) -> DataFrame:
    same = (F.col("name") == name) | (F.col("qualified_name") == name) | F.col("qualified_name").endswith(f":{name}")
    return nodes.filter(same).orderBy("ord").limit(1).select("id", "name")


def file_structure(nodes: DataFrame, edges: DataFrame, path: str | None = None) -> DataFrame:
    """Of each file (or of one): its functions, classes, interfaces, imports and external imports, by edge order."""
    files = nodes.filter((F.col("type") == "File") if path is None else (F.col("type") == "File") & (F.col("path") == path))
    out = files.select(F.col("id").alias("src"), F.col("path").alias("file_path"), F.col("language").alias("file_language"), F.col("line_count").alias("file_lines")).join(edges.select("src", "dst", F.col("type").alias("edge_type"), F.col("ord").alias("edge_ord")), "src", "left")
    target = nodes.select(F.col("id").alias("dst"), F.col("type").alias("kind"), "name", "path", "start_line", "end_line")
    both = out.join(target, "dst", "left")

    def listed(condition: Column, value: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct(F.col("edge_ord").alias("o"), value.alias("v"))))), lambda x: x["v"])

    contains = F.col("edge_type") == "CONTAINS"
    return both.groupBy("file_path", "file_language", "file_lines").agg(
        listed(contains & (F.col("kind") == "Function"), F.col("name")).alias("functions"),
        listed(contains & (F.col("kind") == "Class"), F.col("name")).alias("classes"),
        listed(contains & (F.col("kind") == "Interface"), F.col("name")).alias("interfaces"),
        listed(F.col("edge_type") == "IMPORTS", F.col("path")).alias("imports"),
        listed(F.col("edge_type") == "IMPORTS_EXTERNAL", F.col("name")).alias("external"),
    )


def node_details(nodes: DataFrame, edges: DataFrame, ids: Sequence[str] | DataFrame) -> DataFrame:
    """id, rel_type, direction, related_id, related_name, related_type: all edges at some nodes; no row for unknown ids."""
    wanted = ids if isinstance(ids, DataFrame) else nodes.filter(F.col("id").isin(*ids)).select("id")
    held = edges.select("src", "dst", F.col("type").alias("rel_type"))
    out = wanted.join(held, F.col("id") == F.col("src")).select("id", "rel_type", F.lit("out").alias("direction"), F.col("dst").alias("related_id"))
    into = wanted.join(held, F.col("id") == F.col("dst")).select("id", "rel_type", F.lit("in").alias("direction"), F.col("src").alias("related_id"))
    about = nodes.select(F.col("id").alias("related_id"), F.col("name").alias("related_name"), F.col("type").alias("related_type"))
    return out.unionByName(into).join(about, "related_id")


def graph_nodes(nodes: DataFrame, kinds: Sequence[str] | None = None, limit: int = GRAPH_LIMIT, repo: str | None = None) -> DataFrame:
    """The first nodes in ord, without communities."""
    held = nodes.filter(F.col("type") != "Community")
    if kinds is not None:
        held = held.filter(F.col("type").isin(*kinds))
    if repo:
        held = held.filter(F.col("repo") == repo)
    return held.orderBy("ord").limit(checked(limit))


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among the chosen nodes, without those of communities."""
    ids = chosen.select("id")
    held = edges.filter(~F.col("type").isin(*COMMUNITY_EDGES))
    return held.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type")


def repo_summary(nodes: DataFrame, edges: DataFrame, repo: str | None = None, strict: bool = False) -> DataFrame:
    """One row of counts. The repository limits nodes only, unless `strict`: then edges too."""
    held = nodes.filter(F.col("repo") == repo) if repo else nodes
    kind = F.col("type")
    counted = held.agg(
        F.count_if(kind == "File").alias("file_count"),
        F.coalesce(F.sum(F.when(kind == "File", F.col("line_count"))), F.lit(0)).cast("bigint").alias("total_lines"),
        F.count_if(kind == "Function").alias("function_count"),
        F.count_if(kind == "Class").alias("class_count"),
        F.count_if(kind == "Interface").alias("interface_count"),
        F.sort_array(F.collect_set(F.when(kind == "File", F.col("language")))).alias("languages"),
    )
    own = edges.filter(F.col("repo") == repo) if strict and repo else edges
    linked = own.agg(F.count_if(F.col("type") == "IMPORTS").alias("import_count"), F.count_if(F.col("type") == "CALLS").alias("call_count"))
    both = counted.unionByName(linked, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def communities(nodes: DataFrame, membership: DataFrame, level: int = 1, limit: int = COMMUNITIES_LIMIT) -> DataFrame:
    """Communities of a level, the largest first, with the names of their first ten members; the summary is empty.

    Members are ranked inside their community; only the first ten are gathered."""
    kept = nodes.filter((F.col("type") == "Community") & (F.col("level") == level)).select("id", "name", "member_count", "ord")
    held = membership.filter(F.col("level") == level).join(nodes.select(F.col("id").alias("node_id"), F.col("name").alias("member"), F.col("ord").alias("member_ord")), "node_id")
    counts = held.groupBy("community_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("community_id").orderBy("member_ord"))
    first = held.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE).groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "member"))), lambda x: x["member"]).alias("members"))
    named = kept.withColumn("community_id", F.col("id"))
    return named.join(counts, "community_id", "left").join(first, "community_id", "left").select(
        "id", "name", F.coalesce("member_count", "n", F.lit(0)).cast("bigint").alias("member_count"), F.coalesce("members", F.array().cast("array<string>")).alias("members"), F.lit("").alias("summary"), "ord"
    ).orderBy(F.desc("member_count"), "ord").limit(checked(limit)).drop("ord")


def enclosing(nodes: DataFrame, positions: DataFrame) -> DataFrame:
    """For positions (pos_id, path, line): the narrowest function, class or interface of the file around the line, the
    first of equals; else the file itself.

    Equal spans count once, by their first node. A span is cut into the largest aligned stretches of 2**k lines that make it
    up, at most two for each k, and each stretch keeps the best of its spans. A line lies in one stretch for each k, so it
    meets one row for each at most, however many spans a file has; lines that positions share are looked up once."""
    long = lambda c: F.col(c).cast("bigint")
    nodes_at = nodes.filter(F.col("type").isin("Function", "Class", "Interface")).select(F.col("id").alias("node_id"), path_of(F.col("path"), F.col("qualified_name")).alias("path"), long("start_line").alias("a"), long("end_line").alias("b"), F.col("ord").alias("node_ord"))
    spans = nodes_at.filter("a <= b AND path IS NOT NULL").groupBy("path", "a", "b").agg(F.min(F.struct("node_ord", "node_id")).alias("first"))
    right = lambda value, k: F.call_function("shiftright", value, k)

    def stretches(k: Column) -> Column:
        """What is left at k, [low, high), gives its first stretch if that is odd, and its last if that is even."""
        low, high = right(F.col("a") + right(F.lit((1 << LEVELS) - 1).cast("bigint"), F.lit(LEVELS) - k), k), right(F.col("b") + 1, k)
        one = lambda odd, at: F.when((low < high) & (F.pmod(odd, F.lit(2)) == 1), F.struct(k.alias("level"), at.alias("stretch")))
        return F.array(one(low, low), one(high, high - 1))

    pieces = spans.select("path", (F.col("b") - F.col("a")).alias("length"), "first", F.explode(F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), stretches)))).alias("at"))
    best = pieces.groupBy("path", "at.level", "at.stretch").agg(F.min(F.struct("length", "first")).alias("best"))
    lines = positions.select("path", "line").distinct()
    asked = lines.filter("line IS NOT NULL").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn("stretch", right(long("line"), F.col("level")))
    found = asked.join(best, ["path", "level", "stretch"]).groupBy("path", "line").agg(F.min("best").alias("best")).select(F.col("path").alias("p"), F.col("line").alias("l"), F.col("best.first.node_id").alias("node_id"))
    files = nodes.filter(F.col("type") == "File").select(F.col("id").alias("file_id"), F.col("path").alias("f"))
    known = lines.join(found, (F.col("path") == F.col("p")) & (F.col("line") == F.col("l")), "left").join(files, F.col("path") == F.col("f"), "left")
    known = known.select(F.col("path").alias("p"), F.col("line").alias("l"), F.coalesce("node_id", "file_id").alias("node_id"))
    return positions.join(known, F.col("path").eqNullSafe(F.col("p")) & F.col("line").eqNullSafe(F.col("l")), "left").select("pos_id", "path", "line", "node_id")


def distinct_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes once by id (the first), and edges whose ends are there."""
    once = nodes.withColumn("__r", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).filter("__r = 1").drop("__r")
    ids = once.select("id")
    held = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return once, held


def neighbourhood(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """id, highlighted: the node and those one edge away."""
    near = edges.filter(F.col("src") == node).select(F.col("dst").alias("id")).unionByName(edges.filter(F.col("dst") == node).select(F.col("src").alias("id"))).distinct()
    marked = near.withColumn("__near", F.lit(True))
    return nodes.select("id").join(marked, "id", "left").select("id", (F.coalesce("__near", F.lit(False)) | (F.col("id") == node)).alias("highlighted"))


def visible(edges: DataFrame, kinds: Sequence[str]) -> DataFrame:
    return edges.filter(F.col("type").isin(*kinds))


def colours(nodes: DataFrame, palette: int = PALETTE) -> DataFrame:
    """community_id, colour: the rank of its first appearance, around the palette. One row a community is ranked."""
    first = nodes.filter(F.col("community_id").isNotNull()).groupBy("community_id").agg(F.min("ord").alias("first"))
    return first.select("community_id", ((F.dense_rank().over(Window.orderBy("first", "community_id")) - 1) % palette).cast("int").alias("colour"))

"""Named queries over the driver's tables, each through its operator, with the same results as SQL where there are such.

`@query(sql)` registers a function under its name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.functions import scalars
from weft.functions.extract import diagnostics, extract
from weft.operators import build, community, resolve, search, traverse, vectors
from weft.plans import views
from weft.plans.lineage import cut
from weft.schema import EDGES
from weft.sources import snapshots
from weft.streaming import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- Search and point queries -----------------------------------------------------------------------------------------

_SCORE = """CASE WHEN lower(p_name) = '{p}' THEN 10 WHEN starts_with(lower(p_name), '{p}') THEN 7 WHEN contains(lower(p_name), '{p}') THEN 5
            WHEN contains(lower(p_brand || ':' || p_name), '{p}') THEN 3 END"""


def _search_sql(pattern: str, limit: int, columns: str) -> str:
    return f"""SELECT {columns} FROM (SELECT *, {_SCORE.format(p=pattern)} AS score FROM part) WHERE score IS NOT NULL
               ORDER BY score DESC, p_partkey LIMIT {limit}"""


@query(_search_sql("small", 50, "'Function' AS type, p_name AS name, p_brand || ':' || p_name AS qualified_name, score"))
def search_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_by_name(views.part_nodes(spark, sf_dir), "Small", "Function", 50, views.REPO)


@query(_search_sql("brand#1", 20, "'Function' AS type, p_name AS name, p_brand || ':' || p_name AS qualified_name, score"))
def search_by_qualified_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_by_name(views.part_nodes(spark, sf_dir), "brand#1")


@query(_search_sql("2", 20, "'Function::' || p_partkey AS id, 'Function' AS type, p_name AS name, p_brand || ':' || p_name AS qualified_name, score"))
def search_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_nodes(views.part_nodes(spark, sf_dir), " 2 ")


@query("SELECT 'Function::' || c_custkey AS id, c_name AS name FROM customer WHERE c_name LIKE '%7' ORDER BY c_custkey LIMIT 1")
def highlight_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = views.place_nodes(spark, sf_dir)
    name = nodes.filter("type = 'Function' AND name LIKE '%7'").orderBy("ord").first()["name"]
    return search.highlight_by_name(nodes, name)


@query("SELECT 'File::' || n_nationkey AS id, 'File' AS type, n_name AS name FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 3")
def start_node_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = views.place_nodes(spark, sf_dir)
    path = nodes.filter("id = 'File::3'").first()["path"]
    return search.first_node(nodes, path, by_path=True).select("id", "type", "name")


@query("""
SELECT n_name AS file_path, lower(substr(n_name, 1, 2)) AS language, length(n_name) AS line_count,
       (SELECT coalesce(string_agg(c_name, ', ' ORDER BY c_custkey), '') FROM customer WHERE c_nationkey = n_nationkey) AS functions,
       (SELECT coalesce(string_agg(s_name, ', ' ORDER BY s_suppkey), '') FROM supplier WHERE s_nationkey = n_nationkey) AS classes,
       0 AS interfaces, 0 AS imports
FROM nation""")
def file_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.file_structure(views.place_nodes(spark, sf_dir), views.place_edges(spark, sf_dir))
    return found.select("file_path", F.col("file_language").alias("language"), F.col("file_lines").alias("line_count"), F.array_join("functions", ", ").alias("functions"), F.array_join("classes", ", ").alias("classes"), F.size("interfaces").alias("interfaces"), F.size("imports").alias("imports"))


@query("""
SELECT 'File::' || n_nationkey AS id, 'CONTAINS_FILE' AS rel_type, 'in' AS direction, 'Folder::' || r_regionkey AS related_id, r_name AS related_name, 'Folder' AS related_type
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'File::' || n_nationkey, 'CONTAINS', 'out', 'Function::' || c_custkey, c_name, 'Function' FROM nation JOIN customer ON c_nationkey = n_nationkey
UNION ALL SELECT 'File::' || n_nationkey, 'CONTAINS', 'out', 'Class::' || s_suppkey, s_name, 'Class' FROM nation JOIN supplier ON s_nationkey = n_nationkey""")
def node_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = views.place_nodes(spark, sf_dir)
    return search.node_details(nodes, views.place_edges(spark, sf_dir), nodes.filter("type = 'File'").select("id"))


_PAIRS = """pairs AS (SELECT DISTINCT s, d FROM (
  SELECT l_partkey AS s, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS d
  FROM lineitem) WHERE d IS NOT NULL AND s <> d)"""
_START = "(SELECT s FROM pairs GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)"


@query("SELECT 'Function::' || p_partkey AS id, p_name AS name, p_brand || ':' || p_name AS qualified_name FROM part ORDER BY p_partkey LIMIT 500")
def graph_data_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.graph_nodes(views.part_nodes(spark, sf_dir), ["Function", "Class"], 500).select("id", "name", "qualified_name")


@query(f"""WITH {_PAIRS}, chosen AS (SELECT p_partkey AS k FROM part ORDER BY p_partkey LIMIT 500)
SELECT 'Function::' || s AS src, 'Function::' || d AS dst, 'CALLS' AS type FROM pairs WHERE s IN (SELECT k FROM chosen) AND d IN (SELECT k FROM chosen)""")
def graph_data_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = search.graph_nodes(views.part_nodes(spark, sf_dir), None, 500)
    return search.induced(views.part_edges(spark, sf_dir), chosen)


@query("""
SELECT (SELECT count(*) FROM nation) AS file_count, (SELECT sum(length(n_name))::BIGINT FROM nation) AS total_lines, (SELECT count(*) FROM customer) AS function_count,
       (SELECT count(*) FROM supplier) AS class_count, 0::BIGINT AS interface_count, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT lower(substr(n_name, 1, 2)) AS x FROM nation)) AS languages,
       0::BIGINT AS import_count, 0::BIGINT AS call_count""")
def repo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.repo_summary(views.place_nodes(spark, sf_dir), views.place_edges(spark, sf_dir), views.REPO)
    return found.withColumn("languages", F.array_join("languages", ","))


@query(f"""WITH {_PAIRS}, first AS (SELECT {_START} AS k)
SELECT 'Function::' || p_partkey AS id, p_partkey = k OR p_partkey IN (SELECT d FROM pairs, first WHERE s = k) OR p_partkey IN (SELECT s FROM pairs, first WHERE d = k) AS highlighted FROM part, first""")
def neighbourhood_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = views.part_edges(spark, sf_dir)
    first = _busiest(edges)
    return search.neighbourhood(views.part_nodes(spark, sf_dir), edges, first["src"] if first else "")


@query("""SELECT 'Folder::' || n_regionkey AS src, 'File::' || n_nationkey AS dst FROM nation""")
def relationship_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.visible(views.place_edges(spark, sf_dir), ["CONTAINS_FILE"]).select("src", "dst")


@query("""SELECT 'Function::' || p_partkey AS id, p_name AS name FROM part""")
def distinct_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = views.part_nodes(spark, sf_dir)
    twice = nodes.unionByName(nodes.withColumns({"name": F.lit("again"), "ord": F.col("ord") + 10**9}))
    return search.distinct_graph(twice, views.part_edges(spark, sf_dir))[0].select("id", "name")


@query(f"""WITH {_PAIRS} SELECT 'Function::' || s AS src, 'Function::' || d AS dst FROM pairs WHERE s IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND d IN (SELECT p_partkey FROM part WHERE p_size <= 25)""")
def valid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = views.part_nodes(spark, sf_dir).filter("start_line <= 25")
    return search.distinct_graph(nodes, views.part_edges(spark, sf_dir))[1].select("src", "dst")


@query("""
WITH spans AS (SELECT p_partkey AS k, p_brand AS path, p_size AS a, p_size + 10 AS b FROM part),
pos AS (SELECT event_id AS pos_id, 'Brand#' || (1 + event_id % 5) || (1 + event_id % 3) AS path, (event_id % 70)::INT AS line FROM events),
best AS (SELECT pos_id, k FROM (SELECT pos_id, k, row_number() OVER (PARTITION BY pos_id ORDER BY b - a, k) AS r FROM pos JOIN spans USING (path) WHERE a <= line AND line <= b) WHERE r = 1)
SELECT pos_id, path, line, coalesce('Function::' || k, CASE WHEN path IN (SELECT path FROM spans) THEN 'File::' || path END) AS node_id FROM pos LEFT JOIN best USING (pos_id)""")
def enclosing_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = views.part_nodes(spark, sf_dir)
    brands = views.table(spark, sf_dir, "part").select("p_brand").distinct()
    files = views.typed(brands, functions.schema, id=F.concat(F.lit("File::"), "p_brand"), type=F.lit("File"), path=F.col("p_brand"), ord=F.lit(0))
    k = F.col("event_id")
    at = F.concat(F.lit("Brand#"), (1 + k % 5).cast("string"), (1 + k % 3).cast("string"))
    positions = views.table(spark, sf_dir, "events").select(k.alias("pos_id"), at.alias("path"), (k % 70).cast("int").alias("line"))
    return search.enclosing(functions.unionByName(files), positions)


@query("SELECT 'Function::' || p_partkey AS id, p_brand AS path FROM part")
def path_from_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.part_nodes(spark, sf_dir).select("id", scalars.path_of(F.col("path"), F.col("qualified_name")).alias("path"))


def _busiest(edges: DataFrame):
    """The node with most edges out of it, the first of equals; None without edges."""
    return edges.groupBy("src").agg(F.count("*").alias("n"), F.min("ord").alias("o")).orderBy(F.desc("n"), "o").first()


# --- Traversals -------------------------------------------------------------------------------------------------------


def _reach(depth: int, step: str, name: str = "reach") -> str:
    return f"{name} AS (SELECT {_START} AS id, 0 AS depth UNION SELECT {step}, depth + 1 FROM {name} JOIN {{e}} WHERE depth < {depth})"


def _bfs(depth: int, direction: str) -> str:
    e = {"out": "pairs ON s = id", "in": "pairs ON d = id", "both": "(SELECT s, d FROM pairs UNION SELECT d, s FROM pairs) ON s = id"}[direction]
    return f"WITH RECURSIVE {_PAIRS}, {_reach(depth, 's' if direction == 'in' else 'd').format(e=e)}, near AS (SELECT id, min(depth)::INT AS depth FROM reach GROUP BY id)"


def _file_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    nodes, edges = views.part_nodes(spark, sf_dir, "File"), cut(views.part_edges(spark, sf_dir, "IMPORTS", "File"))
    first = _busiest(edges)
    return nodes, edges, first["src"].partition("::")[2] if first else ""


@query(_bfs(4, "out") + " SELECT id::VARCHAR AS path, p_brand AS language, depth FROM near JOIN part ON p_partkey = id WHERE depth > 0")
def dependencies_depth4(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, start = _file_graph(spark, sf_dir)
    return traverse.dependencies(nodes, edges, start, 4)


@query(_bfs(3, "in") + " SELECT id::VARCHAR AS path, p_brand AS language, depth FROM near JOIN part ON p_partkey = id WHERE depth > 0")
def dependents_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges, start = _file_graph(spark, sf_dir)
    return traverse.dependencies(nodes, edges, start, 3, dependents=True)


def _call_graph(spark: SparkSession, sf_dir: str, direction: str, depth: int) -> DataFrame:
    nodes, edges = views.part_nodes(spark, sf_dir), cut(views.part_edges(spark, sf_dir))
    first = _busiest(edges)
    name = nodes.filter(F.col("id") == first["src"]).first()["qualified_name"] if first else ""
    return traverse.call_graph(nodes, edges, name, depth, direction)


def _call_sql(direction: str, depth: int, at: str) -> str:
    # The start is the first node with the qualified name of the first caller.
    base = _bfs(depth - 1, direction).replace(f"SELECT {_START} AS id, 0 AS depth", f"SELECT min(p_partkey) AS id, 0 AS depth FROM part WHERE p_brand || ':' || p_name = (SELECT p_brand || ':' || p_name FROM part WHERE p_partkey = {_START})")
    return f"""{base} SELECT a.p_brand || ':' || a.p_name AS caller, b.p_brand || ':' || b.p_name AS callee FROM pairs JOIN part a ON a.p_partkey = s JOIN part b ON b.p_partkey = d WHERE {at}"""


@query(_call_sql("in", 3, "d IN (SELECT id FROM near)"))
def call_graph_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _call_graph(spark, sf_dir, "callers", 3)


@query(_call_sql("out", 3, "s IN (SELECT id FROM near)"))
def call_graph_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _call_graph(spark, sf_dir, "callees", 3)


@query(_call_sql("both", 2, "s IN (SELECT id FROM near) OR d IN (SELECT id FROM near)"))
def call_graph_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _call_graph(spark, sf_dir, "both", 2)


@query(_bfs(2, "both") + """ SELECT 'Function' AS type, p_name AS name, p_brand || ':' || p_name AS qualified_name, depth AS distance
FROM near JOIN part ON p_partkey = id WHERE depth > 0 ORDER BY depth, p_name COLLATE NOCASE, p_partkey LIMIT 50""")
def find_related_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = views.part_nodes(spark, sf_dir), cut(views.part_edges(spark, sf_dir))
    first = _busiest(edges)
    named = nodes.withColumn("qualified_name", F.when(F.col("id") == (first["src"] if first else ""), F.lit("start")).otherwise(F.col("qualified_name")))
    return traverse.find_related(named, edges, "start", 2)


@query("""
WITH a AS (SELECT 'File::' || n_nationkey AS id, 'File' AS type, n_name AS name, 'CONTAINS_FILE' AS edge_type, 1 AS depth, n_nationkey AS k FROM nation WHERE n_regionkey = 0)
SELECT id, type, name, edge_type, 'out' AS direction, depth FROM a
UNION ALL SELECT 'Function::' || c_custkey, 'Function', c_name, 'CONTAINS', 'out', 2 FROM customer WHERE c_nationkey IN (SELECT k FROM a)
UNION ALL SELECT 'Class::' || s_suppkey, 'Class', s_name, 'CONTAINS', 'out', 2 FROM supplier WHERE s_nationkey IN (SELECT k FROM a)""")
def run_traversal_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = views.place_nodes(spark, sf_dir)
    start = nodes.filter("id = 'Folder::0'").first()["path"]
    return traverse.run_traversal(nodes, views.place_edges(spark, sf_dir), start, None, "out", 2).drop("qualified_name")


@query(f"""WITH {_PAIRS}, first AS (SELECT {_START} AS k),
one AS (SELECT s AS id, 'in' AS way, s * 10000000 + d AS o FROM pairs, first WHERE d = k UNION ALL SELECT d, 'out', s * 10000000 + d FROM pairs, first WHERE s = k),
l1 AS (SELECT id, way, row_number() OVER (ORDER BY way, o) - 1 AS r FROM (SELECT id, way, o, row_number() OVER (PARTITION BY id ORDER BY way, o) AS n FROM one) WHERE n = 1),
two AS (SELECT s AS id, r, 'in' AS way, s * 10000000 + d AS o FROM pairs JOIN l1 ON d = l1.id UNION ALL SELECT d, r, 'out', s * 10000000 + d FROM pairs JOIN l1 ON s = l1.id),
l2 AS (SELECT id, way FROM (SELECT id, way, row_number() OVER (PARTITION BY id ORDER BY r, way, o) AS n FROM two WHERE id NOT IN (SELECT id FROM l1) AND id <> (SELECT k FROM first)) WHERE n = 1)
SELECT 'Function::' || id AS id, p_name AS name, 'CALLS' AS edge_type, way AS direction, depth FROM (SELECT id, way, 1 AS depth FROM l1 UNION ALL SELECT id, way, 2 FROM l2) JOIN part ON p_partkey = id""")
def run_traversal_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = views.part_nodes(spark, sf_dir), cut(views.part_edges(spark, sf_dir))
    first = _busiest(edges)
    marked = nodes.withColumn("path", F.when(F.col("id") == (first["src"] if first else ""), F.lit("start")))
    return traverse.run_traversal(marked, edges, "start", ["CALLS"], "both", 2).select("id", "name", "edge_type", "direction", "depth")


# --- Construction -----------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT f AS folder FROM (SELECT unnest([source, source || '/' || lang]) AS f FROM documents)")
def folder_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.folder_nodes(views.document_files(spark, sf_dir)).select(F.col("path").alias("folder"))


@query("SELECT DISTINCT 'Folder::' || source AS src, 'Folder::' || source || '/' || lang AS dst FROM documents")
def contains_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.contains_folder(views.document_files(spark, sf_dir)).select("src", "dst")


@query("SELECT 'Folder::' || source || '/' || lang AS src, 'File::' || source || '/' || lang || '/' || doc_id AS dst FROM documents")
def contains_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.contains_file(views.document_files(spark, sf_dir)).select("src", "dst")


@query("SELECT 'File::' || source || '/' || lang || '/' || doc_id AS id, doc_id::VARCHAR AS name, '' AS extension, lang AS language, strlen(text)::BIGINT AS size, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS line_count FROM documents")
def file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = views.document_files(spark, sf_dir).withColumns({"size": F.octet_length("text").cast("bigint"), "lineCount": scalars.line_count(F.col("text"))})
    return build.file_nodes(files).select("id", "name", "extension", "language", "size", "line_count")


@query("""SELECT DISTINCT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS name FROM pages""")
def external_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = views.page_links(spark, sf_dir).groupBy("page_id").agg(F.collect_list(F.struct(F.col("href").alias("specifier"), F.lit(True).alias("isExternal"))).alias("imports"))
    return build.external_modules(links)


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
n AS (SELECT DISTINCT regexp_extract(html, '<h1>([^ <]*)', 1) AS word, FROM pages)
SELECT DISTINCT 'File::' || page_id AS src, 'File::' || substr(href, 2) AS dst FROM l WHERE substr(href, 2) IN (SELECT word FROM n WHERE word <> '')""")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to files that exist: a page imports the file that is named by the first word of some page's heading."""
    words = views.table(spark, sf_dir, "pages").select(F.regexp_extract("html", "<h1>([^ <]*)", 1).alias("path")).filter("path <> ''").distinct()
    nothing = F.array().cast("array<struct<specifier:string,names:array<string>,isDefault:boolean,isExternal:boolean,resolvedPath:string>>")
    named = words.select(F.lit("web").alias("repo"), "path", F.lit(0).alias("file"), nothing.alias("imports"))
    href = F.substring("href", F.lit(2), F.length("href"))
    one = F.struct(F.col("href").alias("specifier"), F.array(F.lit("")).alias("names"), F.lit(False).alias("isDefault"), F.lit(False).alias("isExternal"), href.alias("resolvedPath"))
    pages = views.page_links(spark, sf_dir).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", one.alias("i")))), lambda x: x["i"]).alias("imports"))
    files = pages.select(F.lit("web").alias("repo"), F.col("page_id").cast("string").alias("path"), F.col("page_id").cast("int").alias("file"), "imports")
    return build.merged(build.imports(files.unionByName(named)), ["repo", "src", "dst"]).select("src", "dst")


@query("""
WITH c AS (SELECT p_partkey AS k, unnest(['m' || p_size, 'm' || p_size || '.ts', 'm' || (p_size % 10) || '.tsx', 'm' || p_size || '/index.ts']) AS path, unnest([0, 1, 2, 3]) AS pos FROM part),
p AS (SELECT DISTINCT 'm' || (s_suppkey % 30) || CASE s_suppkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '/index.ts' END AS path FROM supplier)
SELECT p_partkey AS part, r.path AS resolved FROM part LEFT JOIN (SELECT k, arg_min(path, pos) AS path FROM c JOIN p USING (path) GROUP BY k) r ON r.k = p_partkey""")
def resolve_first_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    m = lambda x: F.concat(F.lit("m"), x.cast("string"))
    s = F.col("p_size")
    wanted = p.select(F.col("p_partkey").alias("part"), F.lit("r").alias("repo"), F.array(m(s), F.concat(m(s), F.lit(".ts")), F.concat(m(s % 10), F.lit(".tsx")), F.concat(m(s), F.lit("/index.ts"))).alias("candidates"))
    k = F.col("s_suppkey")
    paths = views.table(spark, sf_dir, "supplier").select(F.lit("r").alias("repo"), F.concat(m(k % 30), F.when(k % 3 == 0, ".ts").when(k % 3 == 1, ".tsx").otherwise("/index.ts")).alias("path"))
    return resolve.first_existing(wanted, paths, ["part"]).select("part", "resolved")


@query("""
WITH fn AS (SELECT p_partkey AS id, p_name AS name, p_brand AS file, p_partkey AS place FROM part),
calls AS (SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey, c.id AS caller, c.file, t.name FROM lineitem l JOIN fn c ON c.id = l_partkey JOIN fn t ON t.id = 1 + (l_suppkey * 7 + l_linenumber) % (SELECT max(p_partkey) FROM part)),
here AS (SELECT file, name, arg_min(id, place) AS id FROM fn GROUP BY file, name), anywhere AS (SELECT name, arg_min(id, place) AS id FROM fn GROUP BY name),
picked AS (SELECT caller, coalesce(h.id, a.id) AS callee FROM calls c LEFT JOIN here h ON h.file = c.file AND h.name = c.name JOIN anywhere a ON a.name = c.name)
SELECT caller, callee, count(*) AS n FROM picked WHERE caller <> callee GROUP BY caller, callee""")
def call_edges_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "part")
    functions = p.select(F.lit("r").alias("repo"), F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("place"))
    last = p.agg(F.max("p_partkey")).first()[0] or 1
    calls = views.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("caller"), (1 + (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % last).alias("target"))
    named = calls.join(functions.select(F.col("id").alias("caller"), "repo", "file", "place"), "caller").join(functions.select(F.col("id").alias("target"), F.col("name").alias("callee_name")), "target")
    return build.resolve_calls(named.select("repo", "file", "caller", "callee_name", "place"), functions).select("caller", "callee", "n")


@query("""
WITH b AS (SELECT p_brand AS name, max(p_partkey) AS last FROM part GROUP BY p_brand)
SELECT p_partkey AS part, last AS base FROM part JOIN b ON name = 'Brand#' || (1 + p_size % 5) || '1' WHERE p_partkey <> last""")
def extends_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as classes named by brand that extend a brand: the last class of the name is meant."""
    p = views.table(spark, sf_dir, "part")
    base = F.concat(F.lit("Brand#"), (1 + F.col("p_size") % 5).cast("string"), F.lit("1"))
    one = F.struct(F.col("p_brand").alias("name"), base.alias("superClass"))
    files = p.select(F.lit("r").alias("repo"), F.col("p_partkey").cast("string").alias("path"), F.col("p_partkey").alias("file"), F.array(one).alias("classes"))
    number = lambda c: F.regexp_extract(c, r"::(\d+):", 1).cast("bigint")
    return build.extends(files).select(number("src").alias("part"), number("dst").alias("base"))


@query("""SELECT 'Function::' || l_partkey AS id, arg_max(l_suppkey, o)::BIGINT AS supplier, min(o)::BIGINT AS ord
FROM (SELECT *, l_orderkey * 100000000 + l_linenumber * 10000000 + l_suppkey * 100 + l_quantity::BIGINT AS o FROM lineitem) GROUP BY l_partkey""")
def merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("l_orderkey") * 100_000_000 + F.col("l_linenumber") * 10_000_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("bigint")
    rows = views.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("Function::"), F.col("l_partkey").cast("string")).alias("id"), F.col("l_suppkey").alias("supplier"), order.alias("ord"))
    return build.merged(rows, ["id"])


@query(f"""WITH {_PAIRS} SELECT 'Function::' || s AS src, 'Function::' || d AS dst FROM pairs JOIN part a ON a.p_partkey = s JOIN part b ON b.p_partkey = d WHERE a.p_size > 10 AND b.p_size > 10""")
def delete_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = F.when(F.col("start_line") <= 10, F.lit("old")).otherwise(F.lit("new"))
    nodes = views.part_nodes(spark, sf_dir).withColumn("repo", small)
    home = nodes.select(F.col("id").alias("src"), F.col("repo").alias("r"))
    target = nodes.select(F.col("id").alias("dst"), F.col("repo").alias("t"))
    # Edges here may join repositories: they go with either end.
    edges = views.part_edges(spark, sf_dir).join(home, "src").join(target, "dst").withColumn("repo", F.when((F.col("r") == "old") | (F.col("t") == "old"), "old").otherwise("new")).select(EDGES.fieldNames())
    gone = nodes.withColumn("repo", F.lit("old")).join(nodes.filter("repo = 'old'").select("id"), "id", "left_semi").unionByName(nodes.filter("repo = 'new'"))
    return build.delete_repo(gone, edges, "old")[1].select("src", "dst")


@query("""SELECT p_partkey AS part, CASE p_partkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'c' WHEN 3 THEN 'cpp' WHEN 4 THEN 'swift' ELSE 'javascript' END AS language,
  'fn_' || p_partkey AS name, CASE p_partkey % 6 WHEN 0 THEN 4 ELSE 3 END AS start_line, 6 AS end_line, 'call_' || (p_partkey % 7) AS calls, CASE p_partkey % 6 WHEN 0 THEN 6 ELSE 7 END + CASE p_partkey % 6 WHEN 0 THEN 1 ELSE 0 END AS lines,
  CASE p_partkey % 6 WHEN 0 THEN 'os' WHEN 1 THEN 'pkg' WHEN 2 THEN 'stdio.h' WHEN 3 THEN 'vector' WHEN 4 THEN 'Foundation' ELSE 'pkg' END AS imports FROM part""")
def extract_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions, calls and imports of a small source for each part, in six languages."""
    parsed = extract(views.sources(spark, sf_dir))
    f = F.explode("functions").alias("f")
    found = parsed.select("language", "lineCount", F.array_join(F.transform("imports", lambda i: i["specifier"]), ",").alias("imports"), f)
    return found.select(F.regexp_extract("f.name", r"(\d+)", 1).cast("bigint").alias("part"), "language", F.col("f.name").alias("name"), F.col("f.startLine").alias("start_line"), F.col("f.endLine").alias("end_line"), F.array_join("f.calls", ",").alias("calls"), F.col("lineCount").alias("lines"), "imports")


@query("""SELECT CASE k WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'c' WHEN 3 THEN 'cpp' WHEN 4 THEN 'swift' ELSE 'javascript' END AS language, n AS passed, 0::BIGINT AS failed
FROM (SELECT p_partkey % 6 AS k, count(*) AS n FROM part GROUP BY 1)""")
def extract_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics(extract(views.sources(spark, sf_dir)))


@query("""
SELECT 'File' AS type, count(*) AS n FROM part UNION ALL SELECT 'Function', count(*) FROM part
UNION ALL SELECT 'Module', count(DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'os' WHEN 1 THEN 'pkg' WHEN 2 THEN 'stdio.h' WHEN 3 THEN 'vector' WHEN 4 THEN 'Foundation' ELSE 'pkg' END) FROM part
UNION ALL SELECT 'Folder', 1 + count(DISTINCT p_partkey % 7) FROM part""")
def build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources to nodes, counted by type."""
    files = build.placed(extract(views.sources(spark, sf_dir)))
    return build.nodes(files).groupBy("type").agg(F.count("*").alias("n"))


@query("""
SELECT 'CONTAINS' AS type, count(*) AS n FROM part UNION ALL SELECT 'IMPORTS_EXTERNAL', count(*) FROM part UNION ALL SELECT 'CONTAINS_FILE', count(*) FROM part
UNION ALL SELECT 'CONTAINS_FOLDER', count(DISTINCT p_partkey % 7) FROM part""")
def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = build.placed(extract(views.sources(spark, sf_dir)))
    return build.edges(files).groupBy("type").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS file_count, count(*) AS function_count, 0::BIGINT AS class_count, 0::BIGINT AS interface_count,
count(DISTINCT CASE p_partkey % 6 WHEN 0 THEN 'os' WHEN 1 THEN 'pkg' WHEN 2 THEN 'stdio.h' WHEN 3 THEN 'vector' WHEN 4 THEN 'Foundation' ELSE 'pkg' END) AS module_count FROM part""")
def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.sync_counts(extract(views.sources(spark, sf_dir)))


_ITEMS = """items AS (SELECT c_custkey AS k, CASE WHEN c_custkey >= 12 THEN (c_custkey - 12)::VARCHAR ELSE 'x' END AS p, c_custkey % 3 AS t,
  'lib/m' || (c_custkey % 4) || '/c' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.cs' ELSE '.py' END AS path FROM customer),
methods AS (
  SELECT k, path, 'load' AS name, '(path: string)' AS parameters, 'Promise<void>' AS return_type, 9 AS start_line, 11 AS end_line, false AS is_exported, true AS is_async, 'helper_' || k AS calls FROM items WHERE t = 0
  UNION ALL SELECT k, path, 'stop', '()', 'number', 12, 12, false, false, '' FROM items WHERE t = 0
  UNION ALL SELECT k, path, 'Run', '()', 'void', 6, 6, true, false, 'Helper_' || k FROM items WHERE t = 1
  UNION ALL SELECT k, path, 'Count', '(int a)', 'int', 7, 7, false, false, '' FROM items WHERE t = 1
  UNION ALL SELECT k, path, 'run', '(self, a)', NULL, 7, 8, true, false, 'helper_' || k FROM items WHERE t = 2
  UNION ALL SELECT k, path, 'stop', '(self)', NULL, 10, 11, true, true, '' FROM items WHERE t = 2)"""


def _of_items(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return extract(views.class_sources(spark, sf_dir)).select("path", F.explode(column).alias("x"))


@query(f"""WITH {_ITEMS} SELECT path, 'Item_' || k AS name, 'Item_' || p AS super_class, CASE t WHEN 0 THEN 'Shape_' || k WHEN 1 THEN 'IItem_' || k ELSE '' END AS interfaces,
  CASE t WHEN 0 THEN 8 WHEN 1 THEN 5 ELSE 6 END AS start_line, CASE t WHEN 0 THEN 13 WHEN 1 THEN 8 ELSE 11 END AS end_line, t = 1 AS is_abstract, true AS is_exported FROM items""")
def extract_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lambda n: F.col(f"x.{n}")
    return _of_items(spark, sf_dir, "classes").select("path", x("name").alias("name"), x("superClass").alias("super_class"), F.array_join(x("interfaces"), ",").alias("interfaces"), x("startLine").alias("start_line"), x("endLine").alias("end_line"), x("isAbstract").alias("is_abstract"), x("isExported").alias("is_exported"))


@query(f"WITH {_ITEMS} SELECT path, name, parameters, return_type, start_line, end_line, is_exported, is_async, calls FROM methods")
def extract_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _of_items(spark, sf_dir, "classes").select("path", F.explode("x.methods").alias("m"))
    x = lambda n: F.col(f"m.{n}")
    return m.select("path", x("name").alias("name"), x("parameters").alias("parameters"), x("returnType").alias("return_type"), x("startLine").alias("start_line"), x("endLine").alias("end_line"), x("isExported").alias("is_exported"), x("isAsync").alias("is_async"), F.array_join(x("calls"), ",").alias("calls"))


@query(f"WITH {_ITEMS} SELECT path, CASE t WHEN 0 THEN 'Shape_' ELSE 'IItem_' END || k AS name, CASE t WHEN 0 THEN 4 ELSE 3 END AS start_line, true AS is_exported FROM items WHERE t < 2")
def extract_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_items(spark, sf_dir, "interfaces").select("path", F.col("x.name").alias("name"), F.col("x.startLine").alias("start_line"), F.col("x.isExported").alias("is_exported"))


@query(f"WITH {_ITEMS} SELECT path, CASE t WHEN 0 THEN 'limit_' ELSE 'LIMIT_' END || k AS name, CASE t WHEN 0 THEN 'number' END AS type, 'const' AS kind, true AS is_exported, CASE t WHEN 0 THEN 6 ELSE 4 END AS start_line FROM items WHERE t <> 1")
def extract_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_items(spark, sf_dir, "variables").select("path", F.col("x.name").alias("name"), F.col("x.type").alias("type"), F.col("x.kind").alias("kind"), F.col("x.isExported").alias("is_exported"), F.col("x.startLine").alias("start_line"))


@query(f"""WITH {_ITEMS}
SELECT path, 'Item_' || k AS name, false AS is_default, 'class' AS kind FROM items UNION ALL SELECT path, CASE t WHEN 0 THEN 'Shape_' ELSE 'IItem_' END || k, false, 'interface' FROM items WHERE t < 2
UNION ALL SELECT path, 'limit_' || k, false, 'variable' FROM items WHERE t = 0 UNION ALL SELECT path, 'make_' || k, true, 'function' FROM items WHERE t = 0""")
def extract_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of_items(spark, sf_dir, "exports").select("path", F.col("x.name").alias("name"), F.col("x.isDefault").alias("is_default"), F.col("x.kind").alias("kind"))


@query(f"""WITH {_ITEMS}, found AS (
  SELECT i.path, CASE i.t WHEN 0 THEN './c' ELSE '.c' END || i.p AS specifier, 'Item_' || i.p AS names, false AS is_default, false AS is_external, b.path AS resolved FROM items i LEFT JOIN items b ON b.k::VARCHAR = i.p WHERE i.t <> 1)
SELECT * FROM found UNION ALL SELECT path, CASE t WHEN 0 THEN 'fs' WHEN 1 THEN 'System' ELSE 'os' END, CASE t WHEN 0 THEN 'fs' WHEN 1 THEN '' ELSE 'os' END, t = 0, true, NULL FROM items""")
def resolve_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of sources, resolved by the candidates that their language tries."""
    parsed = resolve.resolve_imports(cut(extract(views.class_sources(spark, sf_dir))))
    x = lambda n: F.col(f"x.{n}")
    return parsed.select("path", F.explode("imports").alias("x")).select("path", x("specifier").alias("specifier"), F.array_join(x("names"), ",").alias("names"), x("isDefault").alias("is_default"), x("isExternal").alias("is_external"), x("resolvedPath").alias("resolved"))


@query(f"""WITH {_ITEMS}
SELECT 'Class::' || path || ':Item_' || k AS id, 'Class' AS type, 'Item_' || k AS name, t = 1 AS is_abstract FROM items
UNION ALL SELECT 'Interface::' || path || ':' || CASE t WHEN 0 THEN 'Shape_' ELSE 'IItem_' END || k, 'Interface', CASE t WHEN 0 THEN 'Shape_' ELSE 'IItem_' END || k, NULL FROM items WHERE t < 2""")
def class_interface_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = extract(build.placed(views.class_sources(spark, sf_dir)))
    return build.class_and_interface_nodes(files).select("id", "type", "name", "is_abstract")


@query(f"""WITH {_ITEMS}
SELECT 'Class::' || path || ':Item_' || k AS src, 'Function::' || path || ':Item_' || k || '.' || name AS dst, 'HAS_METHOD' AS type FROM methods
UNION ALL SELECT 'Class::' || i.path || ':Item_' || i.k, 'Class::' || b.path || ':Item_' || b.k, 'EXTENDS' FROM items i JOIN items b ON b.k::VARCHAR = i.p
UNION ALL SELECT 'File::' || i.path, 'File::' || b.path, 'IMPORTS' FROM items i JOIN items b ON b.k::VARCHAR = i.p WHERE i.t <> 1""")
def class_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods, bases and imports of built sources."""
    _, edges = build.sync(resolve.resolve_imports(cut(extract(views.class_sources(spark, sf_dir)))))
    return edges.filter(F.col("type").isin("HAS_METHOD", "EXTENDS", "IMPORTS")).select("src", "dst", "type")


# --- Communities ------------------------------------------------------------------------------------------------------


@query(f"""WITH {_PAIRS} SELECT 'Function::' || least(a, b) AS a, 'Function::' || greatest(a, b) AS b, arg_min(w, o)::DOUBLE AS weight FROM (
  SELECT least('' || s, '' || d) AS a, greatest('' || s, '' || d) AS b, CASE WHEN s < d THEN 3.0 ELSE 2.0 END AS w, s * 10000000 + d AS o FROM pairs) GROUP BY a, b""")
def undirected_first_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = views.part_edges(spark, sf_dir)
    number = lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("bigint")
    typed = edges.withColumn("type", F.when(number("src") < number("dst"), "CALLS").otherwise("IMPORTS"))
    return community.projection(typed)


@query()
def louvain_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.partition(views.part_nodes(spark, sf_dir), views.part_edges(spark, sf_dir), 1.0)


@query("SELECT count(*) AS nodes, count(DISTINCT p_partkey) AS placed, true AS labels_are_members, true AS gains FROM part")
def louvain_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for any good partition: each node once, labels among their members, and modularity above both that
    of single nodes and that of one community (0)."""
    nodes, edges = views.part_nodes(spark, sf_dir), cut(views.part_edges(spark, sf_dir))
    labels = cut(community.partition(nodes, edges, 1.0))
    own = labels.groupBy("label").agg(F.max(F.col("node_id") == F.col("label")).alias("own"))
    gains = community.quality(cut(community.projection(edges)), labels) > 0.01
    held = labels.agg(F.count("*").alias("nodes"), F.count_distinct("node_id").alias("placed"))
    return held.select("nodes", "placed", F.lit(own.filter("NOT own").isEmpty()).alias("labels_are_members"), F.lit(gains).alias("gains"))


@query("""
WITH m AS (SELECT c_mktsegment AS s, count(*) AS n, string_agg(c_name, ', ' ORDER BY c_custkey) FILTER (r <= 10) AS members FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) GROUP BY 1)
SELECT 'segment' || s AS id, s AS name, n AS member_count, members, '' AS summary FROM m ORDER BY n DESC, s LIMIT 20""")
def community_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, membership = views.place_nodes(spark, sf_dir), views.memberships(spark, sf_dir)
    segments = membership.filter("level = 1").groupBy("community_id").agg(F.count("*").alias("n"))
    ranked = segments.withColumn("k", F.row_number().over(Window.orderBy("community_id")))
    name = F.regexp_replace("community_id", "^segment", "")
    own = views.typed(ranked, nodes.schema, id=F.col("community_id"), type=F.lit("Community"), name=name, repo=F.lit(""), level=F.lit(1), member_count=F.col("n"), ord=F.col("k") + 6 * 10**12)
    return search.communities(nodes.unionByName(own), membership, 1).withColumn("members", F.array_join("members", ", "))


@query("""
SELECT 0 AS level, 'nation' || c_nationkey AS child, 'segment' || c_mktsegment AS parent, n AS overlap FROM (
  SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r = 1""")
def community_parent_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.parents(views.memberships(spark, sf_dir))


@query("""SELECT 0 AS level, count(DISTINCT c_nationkey) AS communities, count(*) AS members FROM customer
UNION ALL SELECT 1, count(DISTINCT c_mktsegment), count(*) FROM customer""")
def level_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return community.level_report(views.memberships(spark, sf_dir))


@query("""SELECT community_id, ((dense_rank() OVER (ORDER BY f, community_id) - 1) % 20)::INT AS colour FROM (SELECT 'nation' || c_nationkey AS community_id, min(c_custkey) AS f FROM customer GROUP BY 1)""")
def color_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "customer")
    return search.colours(c.select(F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("community_id"), F.col("c_custkey").alias("ord")))


# --- Vectors ----------------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"), "embedding")


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in views.table(spark, sf_dir, "embeddings").orderBy("vec_id").first()["embedding"]]


_TOP = """q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1),
top AS (SELECT vec_id::VARCHAR AS id, 'label ' || label AS text, label, list_dot_product(embedding::DOUBLE[], v) AS s FROM embeddings, q ORDER BY s DESC, id LIMIT 10)"""


@query(f"WITH {_TOP} SELECT id, text, round(s, 6) AS score FROM top")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {_TOP} SELECT id, c_name AS name, floor(s * 1000 + 0.5) / 1000 AS score FROM top LEFT JOIN customer ON c_custkey::VARCHAR = id")
def semantic_search_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.search(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), 10)
    names = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    return found.join(names, "id", "left").select("id", "name", scalars.round3(F.col("score")).alias("score"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10""")
def pairwise_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "embeddings")
    left = e.select(F.col("vec_id").alias("a"), "label", F.col("embedding").alias("x"), (F.col("vec_id") + 10).alias("b"))
    right = e.select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("y"))
    return left.join(right, ["b", "label"]).select("a", "b", F.round(scalars.dot(F.col("x"), F.col("y")), 6).alias("cosine"))


@query("""
SELECT 'Function::' || c_custkey AS id, 'function ' || c_name || ' ((' || c_mktsegment || ')): void in ' AS text FROM customer
UNION ALL SELECT 'Class::' || s_suppkey, 'class ' || s_name || ' methods:  in ' FROM supplier
UNION ALL SELECT 'Folder::' || r_regionkey, 'Folder ' || r_name || ' in ' || r_name FROM region
UNION ALL SELECT 'File::' || n_nationkey, 'file ' || n_name || ' (' || lower(substr(n_name, 1, 2)) || ') contains: ' || coalesce((SELECT string_agg(c_name, ', ' ORDER BY c_custkey) FROM customer WHERE c_nationkey = n_nationkey), '') || ', '
  || coalesce((SELECT string_agg(s_name, ', ' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') || ' imports: ' FROM nation""")
def node_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.descriptions(views.place_nodes(spark, sf_dir), views.place_edges(spark, sf_dir)).select("id", "text")


@query()
def generate_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.generate(views.place_nodes(spark, sf_dir), views.place_edges(spark, sf_dir))
    return found.select("id", F.size("embedding").alias("dimensions"), F.round(scalars.dot(F.col("embedding"), F.col("embedding")), 3).alias("norm"))


@query("SELECT vec_id::VARCHAR AS id, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def base64_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = _vectors(spark, sf_dir).select("id", snapshots.to_base64("embedding").alias("e"))
    back = there.select("id", snapshots.from_base64("e").alias("v"))
    return back.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


# --- Events -----------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, (event_id * 7919) % 10007 AS seq, epoch_us(ts) AS t FROM events)
SELECT event_id, t AS ts_us FROM (SELECT *, max(t) OVER (ORDER BY seq, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e) WHERE m IS NULL OR t > m""")
def event_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events")
    order = F.struct(((F.col("event_id") * 7919) % 10007).alias("a"), F.col("event_id").alias("b"))
    return events.gate(e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), order.alias("seq")), ts="ts_us").select("event_id", "ts_us")


@query("""WITH e AS (SELECT event_type, event_id, epoch_us(ts) AS t, ts FROM events),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p >= 300000000 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY t, event_id) AS s FROM (SELECT *, lag(t) OVER (PARTITION BY event_type ORDER BY t, event_id) AS p FROM e))
SELECT event_type, min(t) AS start_us, count(*) AS n, arg_max(event_id, (t, event_id)) AS event_id FROM g GROUP BY event_type, s""")
def debounce_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select("event_type", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    found = events.debounce(e, "event_id", gap="300 seconds", keys=("event_type",))
    return found.select("event_type", F.unix_micros("start").alias("start_us"), "n", "event_id")


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_ms(ts) AS t FROM events)
SELECT event_id FROM e a WHERE event_type <> 'view' OR NOT EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.event_type = 'click' AND b.t <= a.t AND b.t >= a.t - 3600000)""")
def suppressed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return events.suppressed(e, cursor="view", keys=("user_id",), window_ms=3_600_000).select("event_id")


@query("""WITH e AS (SELECT event_id, event_id % (SELECT 1 + max(c_custkey) FROM customer) AS k FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'File::' || n_nationkey WHEN event_id % 3 = 1 THEN 'Function::' || c_custkey END AS node_id
FROM e LEFT JOIN nation ON n_nationkey = k LEFT JOIN customer ON c_custkey = k""")
def event_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = views.place_nodes(spark, sf_dir)
    all_targets = 1 + (views.table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] or 0)
    e = views.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % all_targets).alias("k"))
    nation = views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("n"))
    customer = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("c"))
    kind = F.when(F.col("event_id") % 3 == 0, "file").when(F.col("event_id") % 3 == 1, "function").otherwise("query")
    aimed = e.join(nation, "k", "left").join(customer, "k", "left").select("event_id", kind.alias("target_type"), F.when(F.col("event_id") % 3 == 0, F.col("n")).otherwise(F.col("c")).alias("target"))
    return events.dispatch(aimed, nodes).select("event_id", "node_id")


# --- Scalars ----------------------------------------------------------------------------------------------------------


@query("""SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS base, regexp_replace(url, '/[^/]*$', '') AS folder, regexp_extract(regexp_extract(url, '([^/]*)/*$', 1), '^.+?(\\.[^.]*)$', 1) AS extension,
  list_filter(string_split(url, '/'), lambda x: x <> '')[-1] AS last, contains(url, '/en/') AS english, strlen(html) AS bytes, length(html) - length(replace(html, chr(10), '')) + 1 AS lines FROM pages""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, url = views.table(spark, sf_dir, "pages"), F.col("url")
    return p.select("page_id", scalars.basename(url).alias("base"), scalars.dirname(url).alias("folder"), scalars.extension(url).alias("extension"), scalars.last_segment(url).alias("last"), scalars.ignored(url, ("en",)).alias("english"), F.octet_length("html").alias("bytes"), scalars.line_count(F.col("html")).alias("lines"))

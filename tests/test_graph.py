"""Construction, resolution, queries, traversals and communities on small graphs made by hand."""

import itertools
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weft.functions.extract import extract
from weft.operators import build, community, resolve, search, traverse, vectors
from weft.plans.catalogue import QUERIES
from weft.plans.engine import Engine
from weft.schema import EDGES, FILES, MEMBERSHIP, NODES


def make_nodes(spark, *rows):
    full = [{**{f.name: None for f in NODES.fields}, "type": "Function", "repo": "r", "ord": i, **r} for i, r in enumerate(rows)]
    for r in full:
        r["name"] = r["name"] if r["name"] is not None else r["id"]
    return spark.createDataFrame([[r[f.name] for f in NODES.fields] for r in full], NODES)


def make_edges(spark, *rows):
    full = [{**{f.name: None for f in EDGES.fields}, "repo": "r", "ord": i, "src": s, "dst": d, "type": t} for i, (s, d, t) in enumerate(rows)]
    return spark.createDataFrame([[r[f.name] for f in EDGES.fields] for r in full], EDGES)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


SOURCES = {
    "src/a.ts": 'import { b } from "./b";\nimport fs from "fs";\nexport function one() { two(); shared(); one(); }\nfunction shared() {}\n',
    "src/b.ts": 'import { one } from "./a";\nimport "./missing";\nexport class Base { run() { one(); } }\nexport class Child extends Base { run() { this.help(); } help() {} }\nexport function two() { shared(); }\n',
    "src/lib/index.ts": "export function shared() {}\nexport interface Shape { x: number }\n",
    "py/pkg/__init__.py": "",
    "py/pkg/mod.py": "from . import x\nfrom .other import y\nimport os\n\ndef go():\n    return y()\n",
    "py/pkg/other.py": "def y(): pass\n",
    "notes.md": "# title\ntext\n",
    "empty.json": "",
}


@pytest.fixture(scope="module")
def parsed(spark):
    kind = {".ts": "typescript", ".py": "python", ".md": "markdown", ".json": "json"}
    files = [("repo", p, None, kind[p[p.rfind(".") :]], len(t), t) for p, t in SOURCES.items()]
    return resolve.resolve_imports(extract(spark.createDataFrame(files, FILES))).cache()


@pytest.fixture(scope="module")
def graph(spark, parsed):
    nodes, edges = build.sync(parsed)
    return nodes.cache(), edges.cache()


def test_sizes_and_lines(parsed):
    found = {r["path"]: (r["size"], r["lineCount"]) for r in parsed.collect()}
    assert found["notes.md"] == (0, 3) and found["empty.json"] == (0, 0) and found["py/pkg/__init__.py"] == (0, 1)
    assert found["py/pkg/other.py"] == (len(SOURCES["py/pkg/other.py"]), 2)


def test_imports_resolve_to_the_first_candidate(parsed):
    found = {(r["path"], i["specifier"]): i["resolvedPath"] for r in parsed.collect() for i in r["imports"]}
    assert found == {
        ("src/a.ts", "./b"): "src/b.ts", ("src/a.ts", "fs"): None, ("src/b.ts", "./a"): "src/a.ts", ("src/b.ts", "./missing"): None,
        ("py/pkg/mod.py", "."): "py/pkg/__init__.py", ("py/pkg/mod.py", ".other"): "py/pkg/other.py", ("py/pkg/mod.py", "os"): None,
    }


def test_nodes(graph):
    found = {r["id"] for r in graph[0].collect()}
    assert {"File::notes.md", "Function::src/a.ts:one", "Function::src/b.ts:Child.help", "Class::src/b.ts:Base", "Interface::src/lib/index.ts:Shape", "Module::fs", "Module::os", "Folder::src/lib", "Folder::py"} <= found
    assert len(found) == graph[0].count()


def test_edges(graph):
    found = {(r["src"], r["dst"], r["type"], r["count"]) for r in graph[1].collect()}
    assert {x for x in found if x[2] == "CALLS"} == {
        ("Function::src/a.ts:one", "Function::src/b.ts:two", "CALLS", 1), ("Function::src/a.ts:one", "Function::src/a.ts:shared", "CALLS", 1),
        ("Function::src/b.ts:Base.run", "Function::src/a.ts:one", "CALLS", 1), ("Function::src/b.ts:Child.run", "Function::src/b.ts:Child.help", "CALLS", 1),
        ("Function::src/b.ts:two", "Function::src/a.ts:shared", "CALLS", 1), ("Function::py/pkg/mod.py:go", "Function::py/pkg/other.py:y", "CALLS", 1),
    }
    assert ("Class::src/b.ts:Child", "Class::src/b.ts:Base", "EXTENDS", None) in found
    assert ("File::src/a.ts", "File::src/b.ts", "IMPORTS", None) in found and ("File::src/a.ts", "Module::fs", "IMPORTS_EXTERNAL", None) in found
    assert ("Folder::src", "Folder::src/lib", "CONTAINS_FOLDER", None) in found and ("Folder::py/pkg", "File::py/pkg/mod.py", "CONTAINS_FILE", None) in found
    assert not {x for x in found if x[0] == x[1]}


def test_classes_and_interfaces_in_one_pass(spark, parsed):
    files = build.placed(parsed).cache()
    both = build.class_and_interface_nodes(files)
    assert rows(both.select("ord", *both.columns[:2])) == rows(build.class_nodes(files).unionByName(build.interface_nodes(files)).select("ord", *both.columns[:2]))
    assert both.exceptAll(build.class_nodes(files).unionByName(build.interface_nodes(files))).count() == 0 < both.count()
    # Nothing is parsed before the query runs, and then once: not for ranges too.
    found = QUERIES["class_interface_nodes"](spark, "/root/testdata/sf0.001")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_sync_counts_and_replacement(spark, parsed, graph):
    counts = build.sync_counts(parsed).first().asDict()
    assert counts == {"file_count": 8, "function_count": 9, "class_count": 2, "interface_count": 1, "module_count": 2}
    nodes, edges = build.sync(parsed.filter("path = 'py/pkg/other.py'"), *graph)
    assert rows(nodes.filter("type = 'Function'").select("id")) == [("Function::py/pkg/other.py:y",)]
    assert nodes.filter("type = 'Module'").count() == 2 and edges.filter("type = 'CALLS'").count() == 0
    left = build.delete_repo(*graph, "repo")
    assert left[0].filter("type <> 'Module'").count() == 0 and left[1].count() == 0


def test_merging_keeps_the_first_place_and_the_last_values(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, None)], "id string, ord int, v string")
    assert rows(build.merged(df, ["id"])) == [("a", 1, "z"), ("b", 2, None)]


def test_search(spark):
    nodes = make_nodes(spark, {"id": "1", "name": "Load"}, {"id": "2", "name": "loader"}, {"id": "3", "name": "reload"}, {"id": "4", "name": "x", "qualified_name": "load.ts:x"}, {"id": "5", "name": "load", "type": "Folder"}, {"id": "6", "name": "lo%d"})
    assert [tuple(r)[1:] for r in search.search_by_name(nodes, "LOAD").collect()] == [("Load", "", 10), ("loader", "", 7), ("reload", "", 5), ("x", "load.ts:x", 3)]
    assert [r["name"] for r in search.search_by_name(nodes, "%").collect()] == ["lo%d"]
    assert search.search_by_name(nodes, "load", limit=0).count() == 0 and search.search_nodes(nodes, "  ").count() == 0
    with pytest.raises(ValueError):
        search.search_by_name(nodes, "load", limit=-1)


CHAIN = [("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("a", "d", "CALLS"), ("d", "c", "CALLS"), ("x", "a", "USES")]


def test_call_graph_and_traversal(spark):
    nodes, edges = make_nodes(spark, *({"id": x} for x in "abcdxy")), make_edges(spark, *CHAIN)
    assert rows(traverse.call_graph(nodes, edges, "a", 1, "callees")) == [("a", "b"), ("a", "d")]
    assert rows(traverse.call_graph(nodes, edges, "a", 2, "callees")) == [("a", "b"), ("a", "d"), ("b", "c"), ("d", "c")]
    assert rows(traverse.call_graph(nodes, edges, "a", 1, "both")) == [("a", "b"), ("a", "d"), ("c", "a")]
    assert traverse.call_graph(nodes, edges, "a", 0).count() == 0 and traverse.call_graph(nodes, edges, "none", 2).count() == 0
    assert rows(traverse.find_related(nodes, edges, "x", 2)) == [("Function", "a", "", 1), ("Function", "b", "", 2), ("Function", "c", "", 2), ("Function", "d", "", 2)]
    found = rows(traverse.run_traversal(nodes, edges, "a", None, "both", 1).select("id", "edge_type", "direction"))
    assert found == [("b", "CALLS", "out"), ("c", "CALLS", "in"), ("d", "CALLS", "out"), ("x", "USES", "in")]
    assert traverse.run_traversal(nodes, edges, "y", None, "both", 3).count() == 0
    with pytest.raises(ValueError):
        traverse.run_traversal(nodes, edges, "a", depth=1.5)


def test_filtered_files_are_not_expanded(spark):
    nodes = make_nodes(spark, *({"id": f"File::{p}", "type": "File", "path": p, "repo": r} for p, r in (("a", "r"), ("b", "other"), ("c", "r"))))
    edges = make_edges(spark, ("File::a", "File::b", "IMPORTS"), ("File::b", "File::c", "IMPORTS"))
    assert rows(traverse.dependencies(nodes, edges, "a", 5).select("path", "depth")) == [("b", 1), ("c", 2)]
    assert traverse.dependencies(nodes, edges, "a", 5, repo="r").count() == 0
    assert rows(traverse.dependencies(nodes, edges, "c", 1, dependents=True).select("path")) == [("b",)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=16))
def test_levels_are_shortest_paths(spark, pairs):
    edges = make_edges(spark, *((str(a), str(b), "E") for a, b in pairs if a != b))
    start = spark.createDataFrame([("0",)], "id string")
    dist, frontier = {0: 0}, [0]
    for d in range(1, 4):
        frontier = [b for b in {b for a, b in pairs if a in frontier and a != b} if b not in dist]
        dist.update(dict.fromkeys(frontier, d))
    assert rows(traverse.levels(edges, start, 3, "out")) == sorted((str(k), v) for k, v in dist.items())


def test_structure_details_and_subgraph(spark, graph):
    nodes, edges = graph
    one = search.file_structure(nodes, edges, "src/b.ts").first()
    assert (one["functions"], one["classes"], one["imports"], one["external"]) == (["two"], ["Base", "Child"], ["src/a.ts"], [])
    assert search.file_structure(nodes, edges, "none").count() == 0
    assert rows(search.node_details(nodes, edges, ["Class::src/b.ts:Base"]).select("rel_type", "direction", "related_name")) == [("CONTAINS", "in", "b.ts"), ("EXTENDS", "in", "Child"), ("HAS_METHOD", "out", "run")]
    chosen = search.graph_nodes(nodes, ["File"], 2)
    assert [r["path"] for r in chosen.collect()] == ["empty.json", "notes.md"] and search.induced(edges, chosen).count() == 0
    summary = search.repo_summary(nodes, edges, "repo").first()
    assert (summary["file_count"], summary["import_count"], summary["call_count"], summary["languages"]) == (8, 4, 6, ["json", "markdown", "python", "typescript"])


def cliques(spark, n=5):
    pairs = [(f"{c}{i}", f"{c}{j}", "CALLS") for c in "ab" for i, j in itertools.combinations(range(n), 2)]
    return make_nodes(spark, *({"id": f"{c}{i}"} for c in "ab" for i in range(n)), {"id": "alone"}), make_edges(spark, *pairs, ("a0", "b0", "CALLS"))


@pytest.mark.parametrize("block", [community.BLOCK, 15])
def test_planted_cliques_are_found(spark, block):
    nodes, edges = cliques(spark)
    found = {r["node_id"]: r["label"] for r in community.partition(nodes, edges, 1.0, block).collect()}
    assert len(found) == 11 and found["alone"] == "alone"
    assert len({found[f"a{i}"] for i in range(5)}) == 1 == len({found[f"b{i}"] for i in range(5)}) and found["a1"] != found["b1"]


def test_louvain_is_deterministic_and_gains():
    pairs = [(i, j, 1.0) for c in (0, 10, 20) for i, j in itertools.combinations(range(c, c + 6), 2)] + [(0, 10, 1.0), (10, 20, 1.0)]
    label = community.louvain(pairs)
    assert label == community.louvain(pairs[::-1]) and len(set(label.values())) == 3
    assert community.modularity(pairs, label) > community.modularity(pairs, {v: v for v in label})
    assert community.louvain([]) == {}


def test_blocks_find_communities_as_good(spark):
    """The same moves in one block give the plain algorithm's labels; more blocks give modularity near to its."""
    r = random.Random(3)
    pairs = {tuple(sorted(r.sample(range(40 * c, 40 * c + 40), 2))) for c in range(6) for _ in range(150)} | {tuple(sorted(r.sample(range(240), 2))) for _ in range(120)}
    rows = sorted((f"n{a:03}", f"n{b:03}", 1.0) for a, b in pairs)
    df = spark.createDataFrame(rows, "a string, b string, weight double")
    plain = community.louvain(rows)
    one = {x["node_id"]: x["label"] for x in community.labelled(df).collect()}
    assert one == plain
    labels = community.labelled(df, block=400)
    found, best = community.quality(df, labels), community.modularity(rows, plain)
    assert found == pytest.approx(community.modularity(rows, {x["node_id"]: x["label"] for x in labels.collect()}))
    assert found > 0.95 * best > 0.4


def test_many_blocks_gain_without_clear_communities(spark):
    """Of a random graph each of many blocks holds a few nodes of a neighbourhood, and all move at once."""
    r = random.Random(5)
    pairs = sorted({tuple(sorted(r.sample(range(100), 2))) for _ in range(500)})
    rows = [(f"n{a:03}", f"n{b:03}", 3.0) for a, b in pairs]
    df = spark.createDataFrame(rows, "a string, b string, weight double")
    label = {x["node_id"]: x["label"] for x in community.labelled(df, block=100).collect()}
    assert set(label) == {x for row in rows for x in row[:2]} and all(label[c] == c <= v for v, c in label.items())
    assert community.modularity(rows, label) > 0.5 * community.modularity(rows, community.louvain(rows)) > 0.06


def test_many_blocks_settle_in_few_steps(spark, monkeypatch):
    """Without clear communities a graph of ten blocks gets as good ones as in one block, and in a bounded number of steps."""
    r, steps, cut = random.Random(5), [], community.cut
    monkeypatch.setattr(community, "cut", lambda df: (steps.append(1), cut(df))[1])
    rows = [(f"n{a:03}", f"n{b:03}", 3.0) for a, b in sorted({tuple(sorted(r.sample(range(300), 2))) for _ in range(3000)})]
    labels = community.labelled(spark.createDataFrame(rows, "a string, b string, weight double"), block=600)
    label = {x["node_id"]: x["label"] for x in labels.collect()}
    assert community.modularity(rows, label) > 0.95 * community.modularity(rows, community.louvain(rows)) > 0.17
    assert len(steps) <= 60


def test_first_weight_of_a_pair_counts(spark):
    edges = make_edges(spark, ("a", "b", "IMPORTS"), ("b", "a", "CALLS"), ("a", "c", "CONTAINS_FILE"), ("a", "Community::x", "BELONGS_TO_COMMUNITY"))
    assert rows(community.projection(edges)) == [("a", "b", 2.0), ("a", "c", 1.0)]


def test_detection_adds_levels_members_and_parents(spark):
    nodes, edges, membership = community.detect(*cliques(spark))
    assert rows(membership.groupBy("node_id").count().select("count").distinct()) == [(3,)]
    assert nodes.filter("type = 'Community' AND level = 1").count() == 3
    assert nodes.filter("id = 'a1'").first()["community_id"].startswith("level1_community")
    assert edges.filter("type = 'PARENT_COMMUNITY'").count() == 6
    again = community.detect(nodes, edges)
    assert again[0].count() == nodes.count() and again[1].count() == edges.count()
    top = search.communities(nodes, membership, 1).collect()
    assert [r["member_count"] for r in top] == [5, 5, 1] and top[0]["members"] == [f"a{i}" for i in range(5)]
    assert rows(community.level_report(membership))[1] == (1, 3, 11)


def test_parent_is_the_first_of_most_overlap(spark):
    m = spark.createDataFrame([(n, 0, "c") for n in "1234"] + [(n, 1, p) for n, p in zip("1234", "qpqp", strict=True)], MEMBERSHIP)
    assert rows(community.parents(m)) == [(0, "c", "p", 2)]


def test_descriptions_and_vectors(spark, graph):
    nodes, edges = graph
    text = {r["id"]: r["text"] for r in vectors.descriptions(nodes, edges).collect()}
    assert text["Function::src/a.ts:one"] == "function one (()): void in "
    assert text["Class::src/b.ts:Child"] == "class Child methods: run, help in "
    assert text["File::src/b.ts"] == "file b.ts (typescript) contains: two, Base, Child imports: a.ts"
    assert text["Module::fs"] == "Module fs in "
    store = vectors.generate(nodes, edges).cache()
    assert {len(r["embedding"]) for r in store.collect()} == {384} and store.filter("id LIKE 'Module%'").count() == 0
    best = vectors.semantic_search(store, nodes, "class Child methods: run, help", 1).first()
    assert best["id"] == "Class::src/b.ts:Child" and 0 < best["score"] <= 1
    assert vectors.search(store, [0.0] * 384, 0).count() == 0
    more = vectors.add(store, spark.createDataFrame([("new", "t", [1.0] * 384), ("Class::src/b.ts:Child", "t", [0.0] * 384)], store.schema))
    again = vectors.add(store, spark.createDataFrame([("new", "t", [1.0] * 384), ("new", "u", [0.5] * 384)], store.schema))
    assert rows(again.filter("id = 'new'").select("text")) == [("u",)]
    assert more.count() == store.count() + 1 and vectors.remove(more, ["new"]).count() == store.count()


def test_engine_answers_and_errors(spark, graph, tmp_path):
    engine = Engine(spark, *graph, repo="repo", events_folder=str(tmp_path))
    assert '"name": "one"' in engine.call("search_code", pattern="one")["text"]
    assert engine.call("search_code", pattern="zzz") == {"isError": False, "text": "No results found."}
    assert engine.call("get_communities")["isError"] and engine.call("nothing")["isError"]
    assert len(list(tmp_path.glob("*.json"))) == 2
    assert '"nodes"' in engine.graph(["File"], 3)


def test_enclosing_and_colours(spark):
    nodes = make_nodes(spark, {"id": "F", "type": "File", "path": "p"}, {"id": "big", "qualified_name": "p:big", "start_line": 1, "end_line": 9}, {"id": "small", "qualified_name": "p:small", "start_line": 3, "end_line": 4, "community_id": "y"}, {"id": "z", "community_id": "x"})
    at = spark.createDataFrame([(1, "p", 3), (2, "p", 8), (3, "p", 50), (4, "q", 1)], "pos_id int, path string, line int")
    assert {r["pos_id"]: r["node_id"] for r in search.enclosing(nodes, at).collect()} == {1: "small", 2: "big", 3: "F", 4: None}
    assert rows(search.colours(nodes)) == [("x", 1), ("y", 0)]


def test_enclosing_spans_of_all_lengths(spark):
    r = random.Random(8)
    spans = [(f"s{i}", "pq"[i % 2], a := r.randint(0, 3000), a + r.choice([0, 1, 2, 3, 7, 8, 9, 64, 500, 2900])) for i in range(120)]
    nodes = make_nodes(spark, *({"id": i, "qualified_name": f"{p}:{i}", "start_line": a, "end_line": b} for i, p, a, b in spans))
    at = [(k, "pq"[k % 2], r.randint(0, 5000)) for k in range(300)]
    found = {x["pos_id"]: x["node_id"] for x in search.enclosing(nodes, spark.createDataFrame(at, "pos_id int, path string, line int")).collect()}
    order = {s[0]: k for k, s in enumerate(spans)}
    for k, p, line in at:
        around = [(b - a, order[i], i) for i, q, a, b in spans if q == p and a <= line <= b]
        assert found[k] == (min(around)[2] if around else None)


def test_enclosing_looks_up_each_line_once(spark):
    """Many positions on the lines of many long spans of one file: rows in between don't grow with their product."""
    k = 3000
    df = spark.range(k)
    nodes = df.selectExpr("concat('s', id) AS id", "'Function' AS type", "concat('p:', id) AS qualified_name", "CAST(NULL AS STRING) AS path", "CAST(id % 3 - 2 AS INT) AS start_line", "CAST(3000 + id % 7 AS INT) AS end_line", "id AS ord")
    nodes = nodes.unionByName(spark.createDataFrame([("F", "File", None, "p", None, None, 0), ("w", "Class", None, "p", -(2**31), 2**31 - 1, 1)], "id string, type string, qualified_name string, path string, start_line int, end_line int, ord bigint"))
    at = spark.range(k).selectExpr("id AS pos_id", "'p' AS path", "CAST(id % 50 AS INT) AS line").unionByName(spark.createDataFrame([(k, "p", 2**31 - 1), (k + 1, "p", -(2**31)), (k + 2, "p", None), (k + 3, None, 1), (k + 4, "p", -2)], "pos_id bigint, path string, line int"))
    out = search.enclosing(nodes, at)
    found = {x["pos_id"]: x["node_id"] for x in out.collect()}
    assert [found[k + i] for i in range(5)] == ["w", "w", "F", None, "s0"]
    assert {found[i] for i in range(k) if i % 50} == {"s14"} and len(found) == k + 5
    counts, todo = [], [out._jdf.queryExecution().executedPlan().executedPlan()]
    while todo:
        node = todo.pop()
        metric = node.metrics().get("numOutputRows")
        counts.append(metric.get().value() if metric.isDefined() else 0)
        inside = [node.plan()] if hasattr(node, "plan") and "QueryStage" in node.nodeName() else []
        children = node.children()
        todo += inside + [children.apply(i) for i in range(children.size())]
    assert max(counts) < 60 * k

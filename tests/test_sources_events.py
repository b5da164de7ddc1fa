"""Walking, snapshots, scalars, events, and the entry module."""

import json
import os

from pyspark.sql import functions as F

from weft.functions import scalars
from weft.operators import vectors
from weft.plans import service
from weft.plans.engine import Engine
from weft.sources import repository, snapshots
from weft.streaming import events


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def tree(root):
    files = {
        "src/a.py": "def f(): pass\n", "src/__init__.py": "", "src/.hidden/x.ts": "let a = 1;\n", "node_modules/m/i.js": "x", "src/build/y.c": "int y;", "logo.png": "binary", "a.lock": "z", "README.md": "# hi\n",
        ".env": "no", "none.xyz": "no", "latin.txt": b"caf\xe9",
    }
    for path, content in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())
    os.symlink(os.path.join(root, "README.md"), os.path.join(root, "link.md"))


def test_walk(spark, tmp_path):
    root = tmp_path / "proj"
    tree(str(root))
    rows = {r["path"]: r for r in repository.walk(spark, str(root)).collect()}
    assert sorted(rows) == ["README.md", "a.lock", "latin.txt", "logo.png", "src/.hidden/x.ts", "src/__init__.py", "src/a.py"]
    assert (rows["logo.png"]["content"], rows["logo.png"]["size"], rows["a.lock"]["content"]) == ("", 6, "")
    assert (rows["src/a.py"]["language"], rows["README.md"]["language"], rows["a.lock"]["language"]) == ("python", "markdown", "other")
    assert {r["repo"] for r in rows.values()} == {"proj"} and rows["latin.txt"]["content"] == "caf�"
    assert repository.walk(spark, str(tmp_path / "missing")).count() == 0
    assert repository.walk(spark, str(root), config=repository.Config(extensions=(".md",))).count() == 1


def test_walk_divides_deep_folders(spark, tmp_path, monkeypatch):
    """A repository whose files are all below one folder is more than one task; wherever it is divided, files are the same."""
    for k in range(12):
        os.makedirs(tmp_path / f"proj/src/a{k % 3}/b{k}", exist_ok=True)
        (tmp_path / f"proj/src/a{k % 3}/b{k}/f.py").write_text("x = 1\n")
    (tmp_path / "proj/src/build").mkdir()
    (tmp_path / "proj/src/build/no.py").write_text("")
    (tmp_path / "proj/src/own.py").write_text("")
    found = set()
    for parts in (1, 2, 5, 256):
        monkeypatch.setattr(repository, "PARTS", parts)
        rows = [r["path"] for r in repository.walk(spark, str(tmp_path / "proj")).collect()]
        assert len(rows) == len(set(rows)) == 13
        found.add(tuple(sorted(rows)))
    assert len(found) == 1 and len(repository._Reader([str(tmp_path / "proj")], repository.Config()).partitions()) > 5


def test_configuration(monkeypatch):
    for name in ("DATA_DIR", "REPO_PATH", "DATA_FILE", "EMBEDDINGS_FILE", "MODEL_CACHE"):
        monkeypatch.delenv(f"WEFT_{name}", raising=False)
    assert repository.Config.load().repo_path == os.getcwd()
    monkeypatch.setenv("WEFT_REPO_PATH", "/r")
    assert repository.Config.load().graph() == "/r/.weft/graph.json" and repository.Config.load(repo_path="/x").vectors() == "/x/.weft/embeddings.json"
    monkeypatch.setenv("WEFT_DATA_FILE", "/d/g.json")
    monkeypatch.setenv("WEFT_EMBEDDINGS_FILE", "/d/e.json")
    monkeypatch.setenv("WEFT_MODEL_CACHE", "/m")
    config = repository.Config.load()
    assert (config.graph(), config.vectors(), config.models()) == ("/d/g.json", "/d/e.json", "/m")
    assert repository.Config(data_dir="/data").graph() == "/data/graph.json"


def test_parse_save_and_load(spark, tmp_path):
    tree(str(tmp_path / "proj"))
    engine = Engine.parse(spark, str(tmp_path / "proj"), embed=True)
    assert engine.search_code("f", "Function").first()["qualified_name"] == "src/a.py:f"
    engine.save(str(tmp_path / "graph"))
    snapshots.save_vectors(engine.store, str(tmp_path / "vectors"))
    there = repository.Config(repo_path=str(tmp_path / "proj"), data_file=str(tmp_path / "graph"), embeddings_file=str(tmp_path / "vectors"))
    held = Engine.configured(spark, there)
    assert held.repo == "proj" and held.semantic_search("f", 1).count() == 1
    assert Engine.configured(spark, repository.Config(repo_path=str(tmp_path / "none"))) is None
    again = Engine.load(spark, str(tmp_path / "graph"))
    assert again.nodes.count() == engine.nodes.count() and again.edges.count() == engine.edges.count()
    assert Engine.load(spark, str(tmp_path / "nothing")) is None
    path = str(tmp_path / "x" / "graph.json")
    snapshots.export_json(engine.nodes, engine.edges, path)
    nodes, edges = snapshots.import_json(spark, path)
    key = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=str)
    assert key(nodes, "id", "type", "name", "start_line") == key(engine.nodes, "id", "type", "name", "start_line")
    assert key(edges, "src", "dst", "type") == key(engine.edges, "src", "dst", "type")
    with open(path, "w") as f:
        f.write("{broken")
    assert snapshots.import_json(spark, path) is None and snapshots.import_json(spark, f"{path}.none") is None
    vectors_path = str(tmp_path / "v.json")
    snapshots.export_vectors(engine.store, vectors_path)
    back = snapshots.import_vectors(spark, vectors_path)
    assert key(back, "id", "text", "embedding") == key(engine.store, "id", "text", "embedding")
    snapshots.save_vectors(engine.store, str(tmp_path / "vp"))
    assert snapshots.load_vectors(spark, str(tmp_path / "vp")).count() == back.count() and snapshots.load_vectors(spark, str(tmp_path / "no")) is None


def test_paths(spark):
    got = lambda f, x: value(spark, f(F.lit(x)))
    assert [got(scalars.normalised, p) for p in ("a/./b/../c", "../x", "a/../..", "./", "a//b")] == ["a/c", "../x", "..", ".", "a/b"]
    assert [got(scalars.extension, p) for p in ("a/b.tar.gz", ".env", "a/.env.example", "none", "x.")] == [".gz", "", ".example", "", "."]
    assert [got(scalars.prefixes, p) for p in ("a/b/c.py", "c.py", "")] == [["a", "a/b"], [], []]
    assert got(scalars.language, "x/y.hpp") == "cpp" and got(scalars.language, "x/y.bin") == "other" and got(scalars.last_segment, "/a/b/") == "b" and got(scalars.last_segment, "/") is None
    assert [value(spark, scalars.round3(F.lit(x))) for x in (0.0005, -0.0005, 1.2344)] == [0.001, 0.0, 1.234]
    assert value(spark, scalars.dot(F.array(F.lit(1.0), F.lit(2.0), F.lit(9.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 11.0


def test_gate_in_batch_and_stream(spark, tmp_path):
    times = [5, 3, 3, 7, 7, 6, 9]
    df = spark.createDataFrame([("tu"[i % 2], "x", "query", t, i) for i, t in enumerate(times)], "tool string, target string, target_type string, ts_ms bigint, seq int")
    assert [r["ts_ms"] for r in events.gate(df).orderBy("seq").collect()] == [5, 7, 9]
    assert [r["ts_ms"] for r in events.gate(df, key="tool").orderBy("seq").collect()] == [5, 3, 7, 7, 9]
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = events.gate_stream(stream, order="seq").writeStream.format("memory").queryName("gated").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["ts_ms"] for r in spark.table("gated").collect()) == [5, 7, 9]


def test_emit_stream_debounce_and_suppress(spark, tmp_path):
    events.emit(str(tmp_path / "e"), "search_code", "x", "query")
    assert spark.read.json(f"{tmp_path}/e").first()["tool"] == "search_code" and events.stream(spark, f"{tmp_path}/e").isStreaming
    events.emit("/proc/none", "a", "b", "c")  # nowhere to write: nothing happens
    base = 1_700_000_000_000
    df = spark.createDataFrame([(base + t, v) for t, v in ((0, "a"), (100, "b"), (350, "c"), (700, "d"))], "ms bigint, v string").withColumn("ts", F.timestamp_millis("ms"))
    assert sorted((r["n"], r["v"]) for r in events.debounce(df, "v").collect()) == [(1, "d"), (3, "c")]
    moves = spark.createDataFrame([("click", 0), ("cursor", 400), ("cursor", 501), ("other", 10)], "event_type string, ts_ms bigint")
    assert sorted(r["ts_ms"] for r in events.suppressed(moves).collect()) == [0, 10, 501]
    many = spark.range(3000).select(F.when(F.col("id") % 700 == 0, "click").otherwise("cursor").alias("event_type"), F.col("id").alias("ts_ms"), F.lit("k").alias("k")).repartition(5)
    assert sorted(r["ts_ms"] for r in events.suppressed(many).collect()) == sorted(r["ts_ms"] for r in events.suppressed(many, keys=("k",)).collect()) == sorted({*range(0, 3000, 700)} | {i for i in range(3000) if i % 700 > 500})


def test_results_as_text(spark):
    assert snapshots.as_json(spark.range(0)) == "No results found." and json.loads(snapshots.as_json(spark.range(1))) == [{"id": 0}]
    assert len(vectors.HashingEmbedder().embed(["", "a"])) == 2
    assert repository.default_paths("/w")["graph"].endswith("graph.json") and repository.repo_name("/a/b/") == "b"


def test_entry_module(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) >= 55 and set(sql) <= set(queries)
    assert entry.entry(spark).columns == ["path", "language", "depth"]


def test_answers_have_all_rows(spark):
    rows = json.loads(snapshots.as_json(spark.range(2500, numPartitions=7)))
    assert rows == [{"id": i} for i in range(2500)]


def test_arguments_of_tools(spark, tmp_path):
    engine = Engine.parse(spark, str(tmp_path), communities=False)
    for tool, arguments in (
        ("search_code", {"pattern": 5}), ("search_code", {}), ("search_code", {"pattern": "x", "kind": "function"}), ("search_code", {"pattern": "x", "limit": "5"}), ("search_code", {"pattern": "x", "more": 1}),
        ("get_dependencies", {"path": "x", "depth": 1.5}), ("get_call_graph", {"function": "x", "direction": "up"}), ("query_graph", {"start": "x", "kinds": "CALLS"}), ("query_graph", {"start": "x", "direction": None}),
        ("get_communities", {"level": -1}), ("semantic_search", {"query": None}),
    ):
        assert engine.call(tool, **arguments)["isError"], (tool, arguments)
    assert engine.call("search_code", pattern="", kind=None, limit=0) == {"isError": False, "text": "No results found."}
    assert not engine.call("query_graph", start="", kinds=["CALLS"])["isError"]


def test_embedding_service_reports_and_recovers(spark):
    state = {"there": False}

    def make():
        if not state["there"]:
            raise OSError("no model")
        return vectors.HashingEmbedder()

    served = vectors.Service(make)
    assert not served.ready and served.initialize() == {"ok": False, "error": "OSError: no model"}
    nodes = spark.createDataFrame([], "id string, type string, name string, qualified_name string, path string")
    store = spark.createDataFrame([], "id string, text string, embedding array<float>")
    engine = Engine(spark, nodes, nodes, store=store, service=served)
    assert "no model" in engine.call("semantic_search", query="x")["text"]
    state["there"] = True
    assert engine.call("semantic_search", query="x") == {"isError": False, "text": "No results found."} and served.ready


def test_routes(spark, tmp_path):
    import threading
    import urllib.request

    tree(str(tmp_path / "proj"))
    engine = Engine.parse(spark, str(tmp_path / "proj"), communities=False)
    status, found = service.route(engine, "/api/graph?types=Function,File&limit=3x")
    assert status == 200 and len(found["nodes"]) == 3 and {n["type"] for n in found["nodes"]} <= {"Function", "File"}
    assert len(service.route(engine, "/api/graph")[1]["nodes"]) == engine.nodes.count() and service.route(engine, "/api/graph?limit=0")[1] == {"nodes": [], "edges": []}
    assert service.route(engine, "/api/graph?limit=x")[0] == 400 and service.route(engine, "/api/graph?types=")[1]["nodes"] == []
    assert [r["id"] for r in service.route(engine, "/api/search?q=f")[1]["results"]] == ["Function::src/a.py:f"]
    assert service.route(engine, "/api/search")[1] == {"results": []} == service.route(engine, "/api/search?q=")[1]
    node = service.route(engine, "/api/node/Function%3A%3Asrc%2Fa.py%3Af")[1]
    assert node["node"]["name"] == "f" and node["relations"][0]["rel_type"] == "CONTAINS"
    assert service.route(engine, "/api/node/none") == (200, {"error": "Node not found"}) and service.route(engine, "/x")[0] == 404
    web = service.server(engine)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    try:
        with urllib.request.urlopen(f"http://127.0.0.1:{web.server_port}/api/search?q=f", timeout=60) as answer:
            assert json.load(answer)["results"][0]["name"] == "f"
    finally:
        web.shutdown()

"""The engine: handles on a graph's tables and the tools that answer questions over them."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from weft.functions.extract import extract
from weft.operators import build, community, resolve, search, traverse, vectors
from weft.plans.lineage import cut
from weft.sources import repository, snapshots
from weft.streaming import events


@dataclass
class Engine:
    """A graph with its memberships and vectors. Tools have the reference's defaults; each emits an event, if there is
    a folder for them, but for the list of communities."""

    spark: SparkSession
    nodes: DataFrame
    edges: DataFrame
    membership: DataFrame | None = None
    store: DataFrame | None = None
    repo: str | None = None
    events_folder: str | None = None
    embedder: Callable[[], vectors.Embedder] = field(default=vectors.HashingEmbedder)
    service: vectors.Service | None = None

    @classmethod
    def parse(cls, spark: SparkSession, *roots: str, communities: bool = True, embed: bool = False, **more) -> Engine:
        """Walk, extract, resolve and build; then communities and vectors. Each step is written, so that files are read
        once, whatever is asked of the graph."""
        parsed = cut(resolve.resolve_imports(cut(extract(repository.walk(spark, *roots)))))
        nodes, edges = map(cut, build.sync(parsed))
        membership = None
        if communities:
            nodes, edges, membership = community.detect(nodes, edges)
            nodes, edges, membership = cut(nodes), cut(edges), cut(membership)
        engine = cls(spark, nodes, edges, membership, repo=repository.repo_name(roots[0]) if len(roots) == 1 else None, **more)
        if embed:
            engine.store = cut(vectors.generate(nodes, edges, engine.embedder))
        return engine

    @classmethod
    def configured(cls, spark: SparkSession, config: repository.Config, **more) -> Engine | None:
        """The saved graph that the configuration names, with its vectors if there are any; None without a graph."""
        found = cls.load(spark, config.graph(), repo=repository.repo_name(config.repo_path or "") or None, **more)
        if found:
            found.store = snapshots.load_vectors(spark, config.vectors())
        return found

    @classmethod
    def load(cls, spark: SparkSession, path: str, **more) -> Engine | None:
        found = snapshots.load_graph(spark, path)
        return cls(spark, *found, **more) if found else None

    def save(self, path: str) -> None:
        snapshots.save_graph(self.nodes, self.edges, path)

    def _said(self, tool: str, target: str, kind: str) -> None:
        if self.events_folder:
            events.emit(self.events_folder, tool, target, kind)

    def search_code(self, pattern: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        self._said("search_code", pattern, "query")
        return search.search_by_name(self.nodes, pattern, kind, limit, self.repo)

    def get_file_structure(self, path: str) -> DataFrame:
        self._said("get_file_structure", path, "file")
        return search.file_structure(self.nodes, self.edges, path)

    def get_dependencies(self, path: str, depth: int = 1) -> DataFrame:
        self._said("get_dependencies", path, "file")
        return traverse.dependencies(self.nodes, self.edges, path, depth, self.repo)

    def get_dependents(self, path: str, depth: int = 1) -> DataFrame:
        self._said("get_dependents", path, "file")
        return traverse.dependencies(self.nodes, self.edges, path, depth, self.repo, dependents=True)

    def get_call_graph(self, function: str, depth: int = 2, direction: str = "both") -> DataFrame:
        self._said("get_call_graph", function, "function")
        return traverse.call_graph(self.nodes, self.edges, function, depth, direction, self.repo)

    def find_related(self, name: str, hops: int = 2) -> DataFrame:
        self._said("find_related", name, "entity")
        return traverse.find_related(self.nodes, self.edges, name, hops, self.repo)

    def get_repo_summary(self) -> DataFrame:
        self._said("get_repo_summary", self.repo or "", "query")
        return search.repo_summary(self.nodes, self.edges, self.repo)

    def query_graph(self, start: str, kinds: Sequence[str] | None = None, direction: str = "both", depth: int = 2) -> DataFrame:
        self._said("query_graph", start, "entity")
        return traverse.run_traversal(self.nodes, self.edges, start, kinds, direction, depth)

    def get_communities(self, level: int = 1, limit: int = 20) -> DataFrame:
        if self.membership is None:
            raise ValueError("communities haven't been detected")
        return search.communities(self.nodes, self.membership, level, limit)

    def semantic_search(self, query: str, limit: int = 10) -> DataFrame:
        self._said("semantic_search", query, "query")
        if self.store is None:
            raise ValueError("there are no vectors")
        if self.service is None:
            self.service = vectors.Service(self.embedder)
        return vectors.semantic_search(self.store, self.nodes, query, limit, self.service.embedder())

    def call(self, tool: str, **arguments) -> dict:
        """A tool by name, as text; an error becomes an answer that says so."""
        try:
            if tool not in TOOLS:
                raise ValueError(f"no such tool: {tool}")
            return {"isError": False, "text": snapshots.as_json(getattr(self, tool)(**valid(tool, arguments)))}
        except Exception as e:  # noqa: BLE001  the caller gets it as text
            return {"isError": True, "text": f"{type(e).__name__}: {e}"}

    def graph(self, kinds: Sequence[str] | None = None, limit: int = 500) -> str:
        """The viewer's subgraph as JSON."""
        chosen = search.graph_nodes(self.nodes, kinds, limit, self.repo)
        edges = search.induced(self.edges, chosen)
        return json.dumps({"nodes": snapshots.json_rows(chosen), "edges": snapshots.json_rows(edges)})


#: Of each tool's arguments what they may be: text, a whole number from 0, one of several words, or a list of words.
_TEXT, _NUMBER, _WORDS = "text", "number", "words"
TOOLS = {
    "search_code": {"pattern": _TEXT, "kind": ("Function", "Class", "Interface", "Variable", "File", "Module", None), "limit": _NUMBER},
    "get_file_structure": {"path": _TEXT},
    "get_dependencies": {"path": _TEXT, "depth": _NUMBER},
    "get_dependents": {"path": _TEXT, "depth": _NUMBER},
    "get_call_graph": {"function": _TEXT, "depth": _NUMBER, "direction": ("callers", "callees", "both")},
    "find_related": {"name": _TEXT, "hops": _NUMBER},
    "get_repo_summary": {},
    "query_graph": {"start": _TEXT, "kinds": _WORDS, "direction": ("in", "out", "both"), "depth": _NUMBER},
    "get_communities": {"level": _NUMBER, "limit": _NUMBER},
    "semantic_search": {"query": _TEXT, "limit": _NUMBER},
}


def valid(tool: str, arguments: dict) -> dict:
    """The arguments, if the tool takes them; else an error that names the first that it doesn't. Empty texts are texts:
    as a pattern one is part of every name, as a name it is nobody's."""
    takes = TOOLS[tool]
    for name, value in arguments.items():
        kind = takes.get(name, "")
        if kind == "":
            raise ValueError(f"{tool} has no argument {name}")
        if kind == _TEXT and not isinstance(value, str):
            raise ValueError(f"{name}: a text is needed, not {value!r}")
        if kind == _NUMBER:
            search.checked(value)
        if kind == _WORDS and value is not None and (isinstance(value, str) or not all(isinstance(x, str) for x in value)):
            raise ValueError(f"{name}: a list of texts or nothing is needed, not {value!r}")
        if isinstance(kind, tuple) and value not in kind:
            raise ValueError(f"{name}: one of {kind} is needed, not {value!r}")
    missing = [name for name, kind in takes.items() if kind == _TEXT and name not in arguments]
    if missing:
        raise ValueError(f"{tool} needs {missing[0]}")
    return arguments

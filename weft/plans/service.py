"""The viewer's routes over an engine: urls to answers, and a small HTTP server for one user."""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import functions as F

from weft.operators import search
from weft.plans.engine import Engine
from weft.sources import snapshots


def route(engine: Engine, url: str) -> tuple[int, object]:
    """(status, answer) of /api/graph?types=A,B&limit=N, /api/search?q=TEXT and /api/node/ID.

    Without types all are meant, without a limit 500 nodes. A limit counts up to its first other character, and must be
    a whole number from 0. No or an empty q finds nothing; a node that isn't there is an answer that says so."""
    parts = urlsplit(url)
    asked = {k: v[0] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
    if parts.path == "/api/graph":
        number = re.match(r"\s*[+]?(\d+)", asked.get("limit", str(search.GRAPH_LIMIT)))
        if not number:
            return 400, {"error": f"no limit: {asked['limit']}"}
        kinds = asked["types"].split(",") if "types" in asked else None
        chosen = search.graph_nodes(engine.nodes, kinds, int(number[1])).persist()
        try:
            return 200, {"nodes": snapshots.json_rows(chosen), "edges": snapshots.json_rows(search.induced(engine.edges, chosen))}
        finally:
            chosen.unpersist()
    if parts.path == "/api/search":
        query = asked.get("q", "")
        return 200, {"results": snapshots.json_rows(search.search_nodes(engine.nodes, query)) if query else []}
    if parts.path.startswith("/api/node/"):
        name = unquote(parts.path.removeprefix("/api/node/"))
        own = snapshots.json_rows(engine.nodes.filter(F.col("id") == name).limit(1))
        if not own:
            return 200, {"error": "Node not found"}
        return 200, {"node": own[0], "relations": snapshots.json_rows(search.node_details(engine.nodes, engine.edges, [name]))}
    return 404, {"error": "Not found"}


def server(engine: Engine, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server of the routes; call serve_forever(). Errors become answers."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            try:
                status, answer = route(engine, self.path)
            except Exception as e:  # noqa: BLE001  the caller gets it as text
                status, answer = 500, {"error": f"{type(e).__name__}: {e}"}
            body = json.dumps(answer).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)

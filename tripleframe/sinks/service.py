"""The same over HTTP: /api/graph, /api/search, /api/sparql, and a site's files."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession

from tripleframe.operators.graphview import GraphView
from tripleframe.operators.metadata import search
from tripleframe.plans.engine import Engine
from tripleframe.plans.parser import QueryError
from tripleframe.sinks.export import bindings_json, graph_parts
from tripleframe.store import TripleStore


def listed(head: str, rows: Iterable[str], tail: str) -> Iterator[str]:
    yield head
    for i, row in enumerate(rows):
        yield f"{',' if i else ''}{row}"
    yield tail


class Service:
    """Answers of (status, JSON in parts); queries see the graph "default", without inference."""

    def __init__(self, spark: SparkSession, triples: DataFrame):
        self.triples = triples
        store = TripleStore(spark)
        store.register("default", triples)
        self.engine = Engine(store)

    def answer(self, path: str) -> tuple[int, str]:
        status, parts = self.parts(path)
        return status, "".join(parts)

    def parts(self, path: str) -> tuple[int, Iterator[str]]:
        """Rows as they come from the cluster, so that an answer of any size is a row at a time in memory."""
        url = urlparse(path)
        ask = {k: v[0] for k, v in parse_qs(url.query).items()}
        error = lambda status, text: (status, iter([json.dumps({"error": text})]))
        if url.path == "/api/graph":
            return 200, graph_parts(GraphView(self.triples))
        if url.path == "/api/search":
            return 200, listed("[", search(self.triples, ask.get("q", "")).orderBy("kind", "uri").toJSON().toLocalIterator(), "]")
        if url.path == "/api/sparql":
            if not ask.get("query"):
                return error(400, "no query")
            try:
                rows = bindings_json(self.engine.execute(ask["query"]).bindings)
            except QueryError as e:
                return error(400, str(e))
            return 200, listed('{"bindings":[', (r[0] for r in rows.toLocalIterator()), "]}")
        return error(404, "no such address")

    def serve(self, folder: str, port: int = 8080) -> ThreadingHTTPServer:
        service = self

        class Handler(SimpleHTTPRequestHandler):
            def __init__(self, *args, **kwargs):
                super().__init__(*args, directory=folder, **kwargs)

            def do_GET(self) -> None:
                if not self.path.startswith("/api/"):
                    return super().do_GET()
                status, parts = service.parts(self.path)
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.end_headers()  # the end of the connection is that of the answer
                for part in parts:
                    self.wfile.write(part.encode())

        return ThreadingHTTPServer(("127.0.0.1", port), Handler)

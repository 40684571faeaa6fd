"""JSON over HTTP for one or several indexes, on the standard library: search, documents, versions, questions, reindexing."""

from __future__ import annotations

import json
import os
import threading
from collections.abc import Callable, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.service import SearchService
from sextant.sources.index import read_manifest
from sextant.sources.reindex import ReindexError, check_name, reindex_index


class Application:
    """Named indexes, opened when first asked for; requests can only name those that are allowed."""

    def __init__(self, spark: SparkSession, indexes: Mapping[str, str], default: str | None = None, encode: Callable | None = None, ask: Callable[[str], dict] | None = None, environ: Mapping[str, str] = os.environ):
        self.spark, self.indexes, self.default = spark, dict(indexes), default or next(iter(indexes), None)
        self.encode, self.ask, self.environ, self.open, self.lock = encode, ask, environ, {}, threading.Lock()

    def folder(self, name: str | None) -> str:
        name = check_name(name or self.default, self.indexes, self.default, self.environ)
        return self.indexes.get(name, name)

    def service(self, name: str | None) -> SearchService:
        folder = self.folder(name)
        with self.lock:
            if folder not in self.open:
                self.open[folder] = SearchService.open(self.spark, folder)
            return self.open[folder]

    def health(self, q: dict) -> dict:
        folder = self.folder(q.get("index"))
        try:
            facts = read_manifest(folder)
        except OSError as e:
            return {"status": "degraded", "loaded": False, "reason": str(e)}
        return {"status": "ok", "loaded": folder in self.open, "index": {k: facts.get(k) for k in ("kind", "n_docs", "dim", "model")}}

    def search(self, q: dict) -> dict:
        if not isinstance(q.get("query"), str):
            raise ValueError("query must be a text")
        version = q.get("version")
        hits = self.service(q.get("index")).search(q["query"], int(q.get("k", 10)), None if version is None else int(version), bool(q.get("all_versions")), category=q.get("category"))
        return {"hits": [r.asDict() for r in hits.collect()]}

    def document(self, q: dict) -> dict:
        return self.service(q.get("index")).get_doc(q["doc_id"])

    def history(self, q: dict) -> dict:
        return {"versions": [r.asDict() for r in self.service(q.get("index")).history(q["id"]).drop("embedding").collect()]}

    def compare(self, q: dict) -> dict:
        return {"changes": [r.asDict() for r in self.service(q.get("index")).compare(q["query"], int(q["a"]), int(q["b"]), int(q.get("k", 10))).collect()]}

    def diff(self, q: dict) -> dict:
        return self.service(q.get("index")).diff(q["id"], int(q["a"]), int(q["b"]))

    def categories(self, q: dict) -> dict:
        return {r["ast_family"]: r["count"] for r in self.service(q.get("index")).categories().collect()}

    def versions(self, q: dict) -> dict:
        return {"versions": self.service(q.get("index")).describe()["versions"]}

    def describe(self, q: dict) -> dict:
        return self.service(q.get("index")).describe()

    def route(self, q: dict) -> dict:
        from sextant.operators.code import looks_like_code

        one = self.spark.createDataFrame([(q["query"],)], "text string")
        return one.select(T.route(F.col("text"), looks_like_code("text")).alias("r")).first()["r"].asDict()

    def agent(self, q: dict) -> dict:
        if self.ask is None:
            raise ReindexError("no sources to ask about", 404)
        return self.ask(q["question"])

    def names(self, q: dict) -> dict:
        return {"default": self.default, "indexes": sorted(self.indexes)}

    def reindex(self, q: dict) -> dict:
        folder = self.folder(q.get("index"))
        if self.encode is None:
            raise ReindexError("this server has no encoder")
        if not self.lock.acquire(blocking=False):
            raise ReindexError("a reindex is running", 409)
        try:
            report = reindex_index(self.spark, folder, self.encode, bool(q.get("dry_run")))
            if report["written"]:
                self.open.pop(folder, None)
            return report
        finally:
            self.lock.release()


GET = {"/health": "health", "/doc": "document", "/history": "history", "/versions": "versions", "/compare": "compare", "/diff": "diff", "/route": "route", "/categories": "categories", "/indexes": "names", "/describe": "describe"}
POST = {"/search": "search", "/reindex": "reindex", "/agent": "agent"}


def answer(app: Application, method: str, target: str, body: bytes = b"") -> tuple[int, dict]:
    """Status and JSON value of a request. Refusals say why; unknown documents are 404."""
    url = urlparse(target)
    name = {"GET": GET, "POST": POST}.get(method, {}).get(url.path)
    if name is None:
        return 404, {"error": f"no such path: {url.path}"}
    try:
        query = {k: v[-1] for k, v in parse_qs(url.query).items()} if method == "GET" else json.loads(body or b"{}")
        return 200, getattr(app, name)(query)
    except ReindexError as e:
        return e.status, {"error": str(e)}
    except KeyError as e:
        return 404, {"error": f"not found: {e}"}
    except (ValueError, TypeError) as e:
        return 400, {"error": str(e)}
    except OSError as e:
        return 404, {"error": str(e)}


def serve(app: Application, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server of the application, not yet running: call serve_forever(). Port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            status, value = answer(app, self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            data = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _do

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)

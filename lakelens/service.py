"""The engine and the gate as request handlers, a small HTTP server around them, and tools for agents."""

from __future__ import annotations

import hmac
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import functions as F

from lakelens.engine import SearchEngine
from lakelens.operators import gate
from lakelens.render import format_results

MAX_RESULTS = 50


class Service:
    """``handle`` answers one request: (status, JSON value)."""

    def __init__(self, engine: SearchEngine, log_path: str):
        self.engine, self.log_path, self.spark = engine, log_path, engine.spark

    def allowed(self, path: str, key: str | None) -> bool:
        wanted = self.engine.settings.api_key
        return not wanted or path == "/healthz" or hmac.compare_digest((key or "").encode(), wanted.encode())

    def handle(self, method: str, target: str, body: bytes = b"", key: str | None = None) -> tuple[int, object]:
        url = urlsplit(target)
        if not self.allowed(url.path, key):
            return 401, {"detail": "invalid or missing API key"}
        routes = {
            ("GET", "/healthz"): lambda q, d: {"status": "ok"}, ("POST", "/search"): lambda q, d: self.search(**d), ("GET", "/status"): lambda q, d: self.engine.status(q["project_id"], q.get("ref", "HEAD")),
            ("POST", "/index"): lambda q, d: self.index(**d), ("POST", "/gate"): lambda q, d: self.gate(**d), ("GET", "/dashboard/data"): lambda q, d: self.dashboard(int(q.get("limit", 100))),
        }
        if (method, url.path) not in routes:
            return 404, {"detail": "not found"}
        try:
            query = {k: v[-1] for k, v in parse_qs(url.query).items()}
            data = json.loads(body) if body else {}
            if not isinstance(data, dict):
                raise ValueError("the body must be an object")
            return 200, routes[method, url.path](query, data)
        except (ValueError, TypeError, KeyError) as problem:
            return 400, {"detail": str(problem)}
        except Exception as problem:
            return 502, {"detail": str(problem)[:300]}

    def search(self, project_id: str, query: str, ref: str = "HEAD", max_results: int = 5, mode: str = "auto") -> dict:
        if not 1 <= max_results <= MAX_RESULTS:
            raise ValueError(f"max_results must be between 1 and {MAX_RESULTS}")
        rows = self.engine.search(project_id, query, ref, max_results, mode)
        hits = [{k: r[k] for k in ("path", "start_line", "end_line", "symbol", "score", "text")} for r in rows]
        return {"results": hits, "text": format_results(query, hits)}

    def index(self, project_id: str, ref: str = "HEAD", force: bool = False) -> dict:
        s = self.engine.index(project_id, ref, force)
        return {"project_id": s.project_id, "ref": s.ref, "files": s.files, "chunks": s.chunks, "skipped": s.skipped, "errors": s.errors}

    def gate(self, sarif: dict, policy: dict | None = None, project_id: str = "", sha: str = "") -> dict:
        d = decide_one(self.spark, json.dumps(sarif), gate.Policy.from_dict(policy))
        row = self.spark.createDataFrame([(project_id, sha, d["state"], d["blocking"], d["warnings"], d["total"], d["reasons"])], "project_id string, sha string, state string, blocking int, warnings int, total int, reasons array<string>")
        gate.append_decisions(row, self.log_path)
        return d | {"passed": d["state"] == "success"}

    def dashboard(self, limit: int = 100) -> dict:
        rows = [r.asDict() for r in gate.recent(gate.read_log(self.spark, self.log_path), limit).drop("id").collect()]
        return {"decisions": rows, "count": len(rows)}

    def tools(self) -> dict:
        """Functions for an agent's tool list."""
        return {
            "semantic_code_search": lambda project_id, query, ref="HEAD", max_results=5, mode="auto": format_results(query, self.engine.search(project_id, query, ref, max_results, mode)),
            "get_symbol": lambda project_id, symbol, ref="HEAD": format_results(symbol, self.engine.search(project_id, symbol, ref, 5, "lexical")),
            "index": lambda project_id, ref="HEAD", force=False: self.index(project_id, ref, force),
            "status": lambda project_id, ref="HEAD": self.engine.status(project_id, ref),
        }

    def serve(self) -> None:
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _answer(self) -> None:
                page = static_file(urlsplit(self.path).path) if self.command == "GET" and service.allowed(self.path, self.headers.get("X-API-Key")) else None
                if page:
                    return self._send(200, *page)
                size = int(self.headers.get("Content-Length") or 0)
                status, value = service.handle(self.command, self.path, self.rfile.read(size), self.headers.get("X-API-Key"))
                self._send(status, "application/json", json.dumps(value, default=str).encode())

            def _send(self, status: int, kind: str, data: bytes) -> None:
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = _answer

        ThreadingHTTPServer((self.engine.settings.host, self.engine.settings.port), Handler).serve_forever()


STATIC = Path(__file__).resolve().parent / "static"
_KINDS = {".html": "text/html; charset=utf-8", ".css": "text/css", ".js": "text/javascript"}


def static_file(path: str) -> tuple[str, bytes] | None:
    """(content type, content) of the dashboard page and of files below ``/static/``; None for any other path."""
    name = "dashboard.html" if path == "/dashboard" else path.removeprefix("/static/") if path.startswith("/static/") else ""
    file = (STATIC / name).resolve()
    if not name or not file.is_relative_to(STATIC) or not file.is_file():
        return None
    return _KINDS.get(file.suffix, "application/octet-stream"), file.read_bytes()


def decide_one(spark, sarif: str, policy: gate.Policy) -> dict:
    """The decision on one report; a report that is not JSON is refused."""
    row = gate.decide(spark.createDataFrame([(sarif,)], "sarif string"), policy).select("state", "blocking", "warnings", "total", F.col("reasons")).first()
    if row is None:
        raise ValueError("the report is not valid JSON")
    return row.asDict()

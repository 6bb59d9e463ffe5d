"""A thin HTTP surface over the engine (standard library only).

``GET /health``, ``GET /v1/namespaces``, and ``POST /v1/namespaces/<name>/``
``write``, ``query`` or ``delete`` with a JSON body. A write creates a missing
namespace. Unknown namespaces are 404, bad input 400, a write that another one
overtook 409, the rest 500.
"""

from __future__ import annotations

import json
import re
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from lodestar.plans.engine import Engine, NamespaceNotFound, WriteConflict

LARGEST_BODY = 32 * 1024 * 1024
DOCUMENTS = "id string, text string, attrs string, pos bigint"


def _documents(engine: Engine, body: dict):
    rows = []
    for k, d in enumerate(body.get("documents") or []):
        if not isinstance(d, dict) or not isinstance(d.get("id"), str) or not isinstance(d.get("text"), str):
            raise ValueError("a document needs texts id and text")
        attrs = json.dumps(d.get("attributes") or {}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        rows.append((d["id"], d["text"], attrs, k))
    return engine.spark.createDataFrame(rows, DOCUMENTS)


def results(df) -> list[dict]:
    """Search results (at most ``top`` rows) as JSON objects."""
    out = []
    for r in df.collect():
        x = r.asDict()
        attrs = x.pop("attributes", None)
        if attrs:
            x["attributes"] = json.loads(attrs)
        out.append(x)
    return out


def handle(engine: Engine, method: str, path: str, body: dict) -> tuple[int, object]:
    """(status, answer) of one request."""
    if method == "GET" and path == "/health":
        return 200, {"status": "ok"}
    if method == "GET" and path == "/v1/namespaces":
        return 200, [r.asDict() for r in engine.list_namespaces().collect()]
    m = re.fullmatch(r"/v1/namespaces/([^/]+)/(write|query|delete)", path)
    if method != "POST" or not m:
        return 404, {"error": "not found"}
    name, action = m.groups()
    try:
        if action == "write":
            try:
                ns = engine.namespace(name)
            except NamespaceNotFound:
                ns = engine.create_namespace(name)
            return 200, vars(ns.write(_documents(engine, body), order="pos"))
        ns = engine.namespace(name)
        if action == "delete":
            return 200, {"deleted": ns.delete([str(i) for i in body.get("ids") or []])}
        found = ns.query(body.get("text") or "", body.get("where"), body.get("mode") or "hybrid", int(body.get("top_k") or 10))
        return 200, {"results": results(found)}
    except NamespaceNotFound:
        return 404, {"error": f"namespace {name!r} not found"}
    except WriteConflict as e:
        return 409, {"error": str(e)}
    except (ValueError, TypeError) as e:
        return 400, {"error": str(e)}
    except Exception as e:
        return 500, {"error": str(e).split("\n")[0]}


def make_server(engine: Engine, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, value: object) -> None:
            raw = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            self._answer(*handle(engine, "GET", self.path, {}))

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if size > LARGEST_BODY:
                self.close_connection = True
                self._answer(400, {"error": "body too large"})
                return
            try:
                body = json.loads(self.rfile.read(size) or b"{}")
            except ValueError:
                body = None
            if not isinstance(body, dict):
                self._answer(400, {"error": "cannot parse the body"})
                return
            self._answer(*handle(engine, "POST", self.path, body))

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)

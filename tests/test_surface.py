import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from lodestar.functions.embed import HashEmbedder
from lodestar.functions.remote import HttpEmbedder
from lodestar.plans import cli
from lodestar.plans.engine import Engine
from lodestar.plans.http_api import make_server


def _serve(server):
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return f"http://127.0.0.1:{server.server_address[1]}"


def _post(url, raw):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, raw)) as r:
            return r.status, json.load(r)
    except urllib.error.HTTPError as e:
        return e.code, json.load(e)


def test_http(spark, tmp_path):
    server = make_server(Engine(spark, str(tmp_path / "db"), HashEmbedder(8)))
    url = _serve(server)
    space = f"{url}/v1/namespaces/n"
    assert _post(f"{space}/query", b'{"text": "x"}')[0] == 404
    docs = {"documents": [{"id": "a", "text": "old"}, {"id": "a", "text": "one parser", "attributes": {"state": "shut"}}]}
    assert _post(f"{space}/write", json.dumps(docs).encode()) == (200, {"written": 1, "skipped": 0, "chunks": 1})
    status, got = _post(f"{space}/query", json.dumps({"text": "parser", "top_k": 5, "where": "state=shut"}).encode())
    assert status == 200 and [(r["id"], r["attributes"]) for r in got["results"]] == [("a", {"state": "shut"})]
    for raw in (b"{", b"[]"):
        assert _post(f"{space}/query", raw)[0] == 400
    assert _post(f"{space}/query", b'{"text": " "}')[0] == 400 and _post(f"{space}/write", b'{"documents": [{"id": 1}]}')[0] == 400
    assert _post(f"{space}/delete", b'{"ids": ["a"]}') == (200, {"deleted": 1})
    with urllib.request.urlopen(f"{url}/health") as r:
        assert json.load(r) == {"status": "ok"}
    server.shutdown()


def test_command_line(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.md").write_text("the importer is flaky")
    (tmp_path / "d.ndjson").write_text('{"id":"x","text":"a parser","attributes":{"source":"web","session":"s1"}}\n')
    engine = Engine(spark, str(tmp_path / "db"), HashEmbedder(8))
    call = lambda *a: cli.run(cli.parser().parse_args(a), engine)
    assert call("add", str(tmp_path / "notes"), str(tmp_path / "d.ndjson"))["written"] == 2
    assert call("search", "flaky", "importer")[0]["id"].endswith("a.md")
    assert call("ls", "web") == {"rows": [{"key": "s1", "documents": 1, "chunks": 1, "created": None}], "total": 1}
    assert call("ls", "--docs", "-n", "0")["total"] == 2
    assert call("rm", "x") == {"deleted": 1} and call("ns", "list")[0]["documents"] == 1
    call("ns", "rm", "default")
    with pytest.raises(LookupError):
        call("search", "x")


def test_http_embedder():
    calls, plan = [], [429, 429, 200, 200, 200]

    class Fake(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append(len(body["input"]))
            status = plan[len(calls) - 1]
            data = [{"index": i, "embedding": [float(len(t)), 0.0]} for i, t in enumerate(body["input"])][::-1]
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps({"data": data}).encode())

        def log_message(self, *_):
            pass

    url = _serve(HTTPServer(("127.0.0.1", 0), Fake))
    e = HttpEmbedder(url, "m", 2, batch=2, waits=(0, 0, 0))
    got = e.embed(["a", "", "bb", "c"])
    assert calls == [2, 2, 2, 1] and [v.tolist() for v in got] == [[1, 0], [0, 0], [1, 0], [1, 0]]
    plan[4] = 401
    with pytest.raises(urllib.error.HTTPError):
        e.embed(["x"])
    assert len(calls) == 5

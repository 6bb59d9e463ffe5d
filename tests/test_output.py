"""Cards, summaries, rendering, model files and the commands that use them."""

import hashlib
import io
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from lodestar.functions.embed import HashEmbedder
from lodestar.functions.models import fetch
from lodestar.functions.summarize import HttpSummarizer, Refused, elide, summary_of
from lodestar.operators import threads
from lodestar.plans import cli, render
from lodestar.plans.engine import Engine


def test_cards_on_disk(spark, tmp_path):
    rows = [("chatgpt", s, p, f"m{p}", r, t, "2023-03-04T05:06:07Z", title) for s, title, turns in (
        ("a", "Rye bread", [("user", "how long does it rise"), ("assistant", "an hour")]), ("b", "漢字", [("user", "q")])) for p, (r, t) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "source string, session string, pos int, turn_id string, role string, text string, created string, title string")
    folder = str(tmp_path / "cards")
    assert threads.write_cards(threads.cards(turns), folder) == {"written": 2, "failed": 0}
    names = lambda: sorted(p.name for p in (tmp_path / "cards").iterdir())
    assert names() == ["2023-03-04-050607-chatgpt-b.md", "2023-03-04-050607-chatgpt-rye-bread.md"]
    renamed = turns.replace("Rye bread", "Oat bread", "title")
    assert threads.write_cards(threads.cards(renamed), folder)["written"] == 2
    assert names() == ["2023-03-04-050607-chatgpt-b.md", "2023-03-04-050607-chatgpt-oat-bread.md"]

    class Broken:
        def summarize(self, title, text):
            raise Refused(title)

    assert threads.write_cards(threads.cards(turns, service=Broken()), folder) == {"written": 2, "failed": 2}
    assert "how long does it rise" in (tmp_path / "cards" / "2023-03-04-050607-chatgpt-rye-bread.md").read_text()
    assert threads.write_cards(threads.cards(turns.limit(0)), folder) == {"written": 0, "failed": 0}


class _Service(BaseHTTPRequestHandler):
    answers: list = []
    asked: list = []

    def do_POST(self):  # noqa: N802
        self.asked.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
        status, body = self.answers.pop(0)
        self.send_response(status)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


def test_summaries():
    server = HTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    s = HttpSummarizer(f"http://127.0.0.1:{server.server_address[1]}", "m", waits=(0, 0))
    _Service.answers = [(429, {}), (503, {}), (200, {"content": [{"text": " It rises. "}]})]
    assert s.summarize("Bread", "text") == "It rises." and _Service.asked[-1]["messages"][0]["content"].endswith("Title: Bread\n\ntext")
    _Service.answers = [(200, {"choices": [{"message": {"content": "Done."}}]}), (200, {"stop_reason": "refusal", "content": []}), (401, {})]
    assert s.summarize("t", "x") == "Done."
    with pytest.raises(Refused):
        s.summarize("t", "x")
    assert summary_of(s, "t", "x", "one two") == ("one two", True) and not _Service.answers  # 401 is not tried again
    assert summary_of(None, "t", "x", "w " * 90)[0].endswith("w…")
    server.shutdown()
    long = "ж" * 40_000
    cut = elide(long)
    assert cut.startswith("ж" * 12_000) and cut.endswith("ж" * 4_000) and "48000 bytes left out" in cut and elide("short") == "short"


def test_rendering():
    assert render.plural(1, "chunk") == "1 chunk" and render.plural(0, "chunk") == "0 chunks"
    assert render.wrap("a lock keeper counts barges", 14, "> ", "  ") == ["> a lock", "  keeper", "  counts", "  barges"]
    assert render.wrap("", 10, "- ") == ["-"] and render.wrap("x" * 30, 10) == ["x" * 30]
    assert [render.text_width(n) for n in (5, 50, 500)] == [32, 50, 84]
    file, turn = {"name": "tides.md", "path": "/t/tides.md", "modified": "2020-02-03T00:00:00Z"}, {"source": "codex", "title": "Locks", "role": "user", "created": "2021-05-06T07:08:09Z", "n": 3}
    assert render.citation("i", file) == "file · tides.md · 2020-02-03" and render.citation("i", turn) == "Codex · Locks · user · 2021-05-06"
    assert render.citation("i", {}) == "i" and render.attr_text(turn, "n", "role") == "user" and render.attr_date({}) == ""
    rows = [{"id": "i", "score": 0.03279, "text": "two\n  lines", "keyword_rank": 1, "semantic_rank": 0, "attributes": turn}]
    assert render.render_results(rows, 40, render.Style(False)) == "1. Codex · Locks · user · 2021-05-06\n   two lines\n   keyword 1 (score 0.0328)"
    assert "\x1b[1m" in render.render_results(rows, 40, render.Style(True)) and render.render_results([]) == "no matches"
    page = render.render_rows([{"key": "s", "documents": 2, "created": "2021-05-06T07:08:09Z"}], 5, "session", 2)
    assert page == "2021-05-06  s  2 documents\n3-3 of 5 sessions"


def test_model_files(tmp_path):
    (tmp_path / "m.bin").write_bytes(b"weights")
    url, good = (tmp_path / "m.bin").as_uri(), hashlib.sha256(b"weights").hexdigest()
    seen = []
    path = fetch(url, good, str(tmp_path / "cache"), seen.append)
    assert open(path, "rb").read() == b"weights" and seen == [7]
    (tmp_path / "m.bin").unlink()
    assert fetch(url, good, str(tmp_path / "cache")) == path  # kept
    (tmp_path / "m.bin").write_bytes(b"other")
    for bad in ("", "0" * 64):
        with pytest.raises(ValueError):
            fetch(url, bad, str(tmp_path / "cache"))
    assert len(list((tmp_path / "cache").iterdir())) == 1


def test_seed_and_standard_input(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "a.md").write_text("sluice gates")
    engine = Engine(spark, str(tmp_path / "db"), HashEmbedder(8))
    call = lambda *a: cli.run(cli.parser().parse_args(a), engine)
    assert call("seed", str(tmp_path / "notes"))["written"] == 1
    attrs = json.loads(engine.namespace("default").docs().first()["attrs"])
    assert set(attrs) == {"modified", "name", "path", "size"} and attrs["size"] == 12
    with pytest.raises(ValueError):
        call("seed", str(tmp_path / "none"))
    monkeypatch.setattr("sys.stdin", io.StringIO('{"id": "x", "text": "one"}\n\n{"id": 5}\n{"id": "y", "text": "two"}\n'))
    assert call("add", "-")["written"] == 2
    assert "-: line 3: missing id" in capsys.readouterr().err
    with pytest.raises(ValueError):
        call("rm", "default")
    args = cli.parser().parse_args(["search", "sluice"])
    assert "a.md" in cli.as_text(args, cli.run(args, engine))
    args = cli.parser().parse_args(["ls", "--docs"])
    assert cli.as_text(args, cli.run(args, engine)).endswith("3 documents")

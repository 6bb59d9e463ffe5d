import io
import json
import zipfile

import pytest

from lodestar.functions.embed import HashEmbedder
from lodestar.plans.cli import import_documents
from lodestar.plans.engine import Engine
from lodestar.sources import exports, files
from lodestar.sources.ndjson import parse_lines
from lodestar.streaming.ingest import ingest_ndjson


def _rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("session", "pos").collect()]


def test_ndjson(spark):
    lines = ['{"id":"a","text":"x","attributes":{"n":1}}', '{"id":"b","text":"y"}', "{", "[1]", '{"text":"x"}', '{"id":"","text":"x"}', '{"id":"c"}', '{"id":"c","text":""}', " "]
    got = parse_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["id"], r["attrs"]) for r in got if r["error"] is None] == [("a", '{"n":1}'), ("b", "{}")]
    assert sorted(r["error"] for r in got if r["error"]) == ["malformed JSON", "missing id", "missing id", "missing text", "missing text", "not an object"]


def test_graph_order():
    ids = ["r", "b", "a", "o", "c1", "c2"]
    parents = [None, "r", "r", "elsewhere", "c2", "c1"]
    children = [["b", "a"], [], [], [], ["c2"], ["c1"]]
    assert [ids[i] for i in exports.walk_order(ids, parents, children)] == ["r", "b", "a", "o", "c1", "c2"]


def test_chatgpt(spark, tmp_path):
    node = lambda role, parts, parent, kids, **m: {"message": {"id": None, "author": {"role": role}, "create_time": 1650001234.25, "content": {"content_type": "text", "parts": parts}, **m}, "parent": parent, "children": kids}
    conv = [{"title": " T ", "conversation_id": "c1", "mapping": {
        "root": {"message": None, "parent": None, "children": ["m1"]},
        "m1": node("system", ["not shown"], "root", ["m2"], metadata={"is_visually_hidden_from_conversation": True}),
        "m2": node("user", ["hello", {"text": "picture"}], "m1", ["m3"]), "m3": node("assistant", ["answer"], "m2", []), "m4": node("user", ["left over"], "elsewhere", [])}}]
    (tmp_path / "conversations.json").write_text(json.dumps(conv))
    got = _rows(exports.read_chatgpt(spark, str(tmp_path / "conversations.json")), "turn_id", "role", "text", "title", "created")
    assert got == [("m2", "user", "hello\npicture", "T", "2022-04-15T05:40:34Z"), ("m3", "assistant", "answer", "T", "2022-04-15T05:40:34Z"), ("m4", "user", "left over", "T", "2022-04-15T05:40:34Z")]
    assert files.detect(str(tmp_path)) == "chatgpt"


def _conv(i, **m):
    return {"conversation_id": f"c{i}", "title": "T", "mapping": {"n": {"message": {"author": {"role": "user"}, "content": {"parts": [f"text {i}"]}, **m}}}}


def test_a_bad_element_costs_itself_alone(spark, tmp_path, capsys):
    convs = [_conv(i) for i in range(6)]
    convs[2]["mapping"] = "none"
    convs[3]["mapping"]["n"]["children"] = "none"
    convs[4]["create_time"] = convs[4]["mapping"]["n"]["message"]["create_time"] = "2024-01-01 00:00:00"
    p = tmp_path / "conversations.json"
    p.write_text(json.dumps([*convs, 5]))
    assert [r["session"] for r in exports.read_chatgpt(spark, str(p)).orderBy("session").collect()] == ["c0", "c1", "c4", "c5"]
    assert exports.read_chatgpt(spark, str(p)).where("session = 'c4'").first()["created"] == "2024-01-01T00:00:00Z"
    got = exports.export_elements(spark, str(p), exports.CHATGPT).where("error is not null").orderBy("element_no").collect()
    assert [(r["element_no"], json.loads(r["raw"])) for r in got] == [(2, convs[2]), (3, convs[3]), (6, 5)]
    assert import_documents(spark, str(p)).count() == 4 and ": 3 elements of conversations.json" in capsys.readouterr().err
    p.write_text(json.dumps(convs[:2])[:-1] + ', {"cut')
    assert [r["session"] for r in exports.read_chatgpt(spark, str(p)).orderBy("session").collect()] == ["c0", "c1"]
    p.write_text(json.dumps([{"uuid": "a", "chat_messages": [{"text": "x"}]}, {"uuid": "b", "chat_messages": "x"}]))
    assert [r["session"] for r in exports.read_claude(spark, str(p)).collect()] == ["a"]


@pytest.mark.parametrize("chunk", [1, 2, 7, 1000])
def test_array_elements(chunk):
    read = lambda t: list(files.array_elements(io.BytesIO(t.encode()), chunk))
    assert read(' [ 12 , {"a": "é]"},[ ], "x,"] ') == [("12", None), ('{"a": "é]"}', None), ("[ ]", None), ('"x,"', None)]
    assert read("[]") == [] and read("{}") == read("") == [(None, "not a JSON array")]
    assert read("[1, {") == read("[1, ") == read("[1, x, 2]") == [("1", None), (None, "malformed JSON")]
    assert read("[1 2]") == read("[1") == [("1", None), (None, "malformed JSON")]


def test_claude(spark, tmp_path):
    conv = [{"uuid": "u", "name": "N", "chat_messages": [
        {"uuid": "m1", "sender": "human", "created_at": "2022-09-18T21:40:05.3Z", "text": "flat", "content": [{"type": "text", "text": "block"}], "attachments": [{"file_name": "f", "extracted_content": "inside"}]},
        {"uuid": "", "sender": "assistant", "text": "reply", "content": [], "attachments": []}, {"uuid": "x", "sender": "human", "text": " ", "content": []}]}]
    (tmp_path / "conversations.json").write_text(json.dumps(conv))
    got = _rows(exports.read_claude(spark, str(tmp_path / "conversations.json")), "turn_id", "role", "text", "created")
    assert got[0] == ("m1", "user", "block\nf\ninside", "2022-09-18T21:40:05Z") and got[1][:3] == ("m1", "assistant", "reply")
    assert files.detect(str(tmp_path / "conversations.json")) == "claude"


def test_claude_code_and_codex(spark, tmp_path):
    (tmp_path / "cc").mkdir()
    cc = [
        {"type": "summary", "summary": "About tides", "leafUuid": "k-2"}, {"type": "user", "uuid": "k-1", "sessionId": "ses-4", "timestamp": 1640995261000, "message": {"role": "user", "content": "hi"}},
        {"type": "user", "uuid": "k-7", "isMeta": True, "message": {"role": "user", "content": "meta"}},
        {"type": "assistant", "uuid": "k-2", "sessionId": "ses-4", "isSidechain": True, "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "name": "x"}, {"type": "text", "text": "ok"}]}},
        {"type": "user", "uuid": "k-3", "message": {"role": "user", "content": [{"type": "tool_result", "content": "no"}]}}, {"type": "ai-title", "aiTitle": "Tide tables"},
    ]
    (tmp_path / "cc" / "s.jsonl").write_text("\n".join(map(json.dumps, cc)) + "\nnot json\n")
    got = _rows(exports.read_claude_code(spark, str(tmp_path / "cc")), "session", "title", "turn_id", "role", "text")
    assert got == [("ses-4", "Tide tables", "line1", "summary", "About tides"), ("ses-4", "Tide tables", "k-1", "user", "hi"), ("ses-4", "Tide tables", "k-2", "assistant/subagent", "hm\nok")]
    assert files.detect(str(tmp_path / "cc")) == "claude-code"
    (tmp_path / "cx").mkdir()
    cx = [
        {"type": "session_meta", "timestamp": "2023-11-30T07:15:00Z", "payload": {"id": "thread-31", "cwd": "/srv/tides"}}, {"type": "session_meta", "payload": {"id": "thread-32"}},
        {"type": "response_item", "payload": {"type": "message"}}, {"type": "event_msg", "timestamp": "2023-11-30T07:15:42Z", "payload": {"type": "user_message", "message": "do  it"}},
        {"type": "event_msg", "payload": {"type": "agent_message", "message": "done"}},
    ]
    (tmp_path / "cx" / "r.jsonl").write_text("\n".join(map(json.dumps, cx)))
    got = _rows(exports.read_codex(spark, str(tmp_path / "cx")), "session", "title", "turn_id", "role", "text")
    assert got == [("thread-31", "do it", "line4", "user", "do  it"), ("thread-31", "do it", "line5", "assistant", "done")]
    assert files.detect(str(tmp_path / "cx")) == "codex"


def test_archives_and_nested_folders_are_read(spark, tmp_path):
    big = [_conv(i) for i in range(3)]
    big[0]["padding"] = "x" * (files.LARGEST + 1)
    cc = "\n".join(json.dumps({"type": "user", "uuid": f"u{i}", "message": {"role": "user", "content": f"hi {i}"}}) for i in range(3))
    claude = [{"uuid": "u", "name": "N", "chat_messages": [{"uuid": "m", "sender": "human", "text": "said"}]}]
    projects = [{"uuid": "p", "name": "P", "description": " about ", "docs": [{"filename": "f.md", "content": "inside"}]}, {"docs": 1}]
    holds = {
        "gpt": {"x/conversations.json": json.dumps(big[1:] + big[:1]), "x/y/conversations.json": "[]"}, "cc": {"p/s.jsonl": cc, "T.JSONL": cc},
        "claude": {"e/conversations.json": json.dumps(claude), "e/projects.json": json.dumps(projects)},
    }
    for name, entries in holds.items():
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for n, text in entries.items():
                z.writestr(n, text)
                (tmp_path / name / n).parent.mkdir(parents=True, exist_ok=True)
                (tmp_path / name / n).write_text(text)
    for suffix in ("", ".zip"):
        got = lambda name: sorted(r["id"] for r in import_documents(spark, str(tmp_path / name) + suffix).collect())  # noqa: B023, E731
        assert got("gpt") == ["chatgpt:c0:n", "chatgpt:c1:n", "chatgpt:c2:n"]
        assert got("cc") == [f"claude-code:{s}:u{i}" for s in ("T", "s") for i in range(3)]
        assert got("claude") == ["claude:project:p", "claude:project:p:doc0", "claude:u:m"]


def test_detection_of_large_first_elements(tmp_path):
    pad = "x" * (5 << 20)
    for name, text, kind in (
        ("conversations.json", json.dumps([{"title": pad, **_conv(0)}]), "chatgpt"), ("c.json", json.dumps([{"name": pad, "chat_messages": []}]), "claude"),
        ("s.jsonl", json.dumps({"message": pad, "sessionId": "S"}), "claude-code"),
    ):
        (tmp_path / name).write_text(text)
        assert files.detect(str(tmp_path / name)) == kind
    (tmp_path / "conversations.json").write_text("[]")
    with pytest.raises(ValueError):
        files.detect(str(tmp_path))


def test_files_and_detection(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("shelf/tides.md", "# Tides")
        z.writestr("shelf/chart.md", b"ab\x00\xff")
        z.writestr("shelf/run.rs", "fn main() {}")
    got = [(r["id"], r["text"]) for r in files.file_documents(spark, str(tmp_path / "a.zip")).collect()]
    assert got == [(f"{tmp_path}/a.zip!shelf/tides.md", "# Tides")]
    assert files.detect(str(tmp_path / "a.zip")) == "files"
    assert files.shallowest(["a/b/conversations.json", "c/Conversations.json"], "conversations.json") == "c/Conversations.json"
    for bad in ('{"a": []}', "[ ]", '[{"uuid":"x"}]', "plain"):
        with pytest.raises(ValueError):
            files.sniff_export(bad)


def test_stream_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.ndjson").write_text('{"id":"a","text":"one parser"}\nbad\n')
    n = Engine(spark, str(tmp_path / "db"), HashEmbedder(8)).create_namespace("s")
    ingest_ndjson(spark, str(src), n, str(tmp_path / "cp")).awaitTermination()
    (src / "2.ndjson").write_text('{"id":"b","text":"two"}\n{"id":"a","text":"one parser"}\n')
    ingest_ndjson(spark, str(src), n, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["id"] for r in n.docs().collect()) == ["a", "b"]
    assert n.query("parsers", mode="keyword").first()["id"] == "a"


def _attributes(spark, path, per="turn"):
    rows = import_documents(spark, str(path), per=per).collect()
    return {r["id"]: json.loads(r["attrs"]) for r in rows}


def test_attributes_of_whole_conversations(spark, tmp_path):
    gpt = [
        {"title": "Bread", "create_time": 1650001234, "mapping": {"n": {"message": {"author": {"role": "user"}, "content": {"parts": ["rye"]}}}}},
        {"conversation_id": "c7", "mapping": {"n": {"message": {"author": {"role": "user"}, "create_time": 1650005678, "content": {"parts": ["oats"]}}}}},
    ]
    (tmp_path / "conversations.json").write_text(json.dumps(gpt))
    got = _attributes(spark, tmp_path / "conversations.json")
    assert got == {
        "chatgpt:conversation-0:n": {"created": "2022-04-15T05:40:34Z", "index": 0, "kind": "message", "role": "user", "session": "conversation-0", "source": "chatgpt", "title": "Bread"},
        "chatgpt:c7:n": {"created": "2022-04-15T06:54:38Z", "index": 0, "kind": "message", "role": "user", "session": "c7", "source": "chatgpt"},
    }
    whole = _attributes(spark, tmp_path / "conversations.json", "conversation")
    assert whole["chatgpt:conversation-0"] == {"created": "2022-04-15T05:40:34Z", "kind": "conversation", "messages": 1, "session": "conversation-0", "source": "chatgpt", "title": "Bread"}
    home = tmp_path / "cc" / "-srv-bakery"
    home.mkdir(parents=True)
    said = lambda n, **m: {"type": "user", "uuid": f"k{n}", "message": {"role": "user", "content": f"t{n}"}, **m}
    lines = [said(1, cwd="/srv/old", gitBranch="main", timestamp="2022-01-02T03:04:05.6Z"), said(2, cwd="/srv/bakery", gitBranch="rye"), said(3, isMeta=True, cwd="/no")]
    (home / "s.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = _attributes(spark, tmp_path / "cc")
    assert got["claude-code:s:k2"] == {
        "branch": "rye", "created": "2022-01-02T03:04:05Z", "cwd": "/srv/bakery", "index": 1, "kind": "message", "project": "-srv-bakery", "role": "user", "session": "s", "source": "claude-code",
    }
    (tmp_path / "cx").mkdir()
    meta = lambda i, **m: {"type": "session_meta", "timestamp": "2022-05-06T07:08:09Z", "payload": {"id": i, **m}}
    turn = {"type": "event_msg", "payload": {"type": "user_message", "message": "knead the dough"}}
    (tmp_path / "cx" / "r.jsonl").write_text("\n".join(map(json.dumps, [meta("new", cwd="/srv/bakery/"), meta("old", cwd="/other"), turn])))
    assert _attributes(spark, tmp_path / "cx", "conversation")["codex:new"] == {
        "created": "2022-05-06T07:08:09Z", "cwd": "/srv/bakery/", "forked_from": "old", "kind": "conversation", "messages": 1, "project": "bakery", "session": "new", "source": "codex",
        "title": "knead the dough",
    }

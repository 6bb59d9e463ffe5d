import json
import math
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import filters as fl
from lodestar.functions import scalars
from lodestar.functions.embed import HashEmbedder, decode_vector, encode_vector, read_safetensors
from lodestar.functions.text import index_tokens, query_terms, window_chunks
from lodestar.operators import listing, search, threads
from lodestar.operators.index import build_index
from lodestar.plans.engine import Engine, NamespaceNotFound, WriteConflict

CORPUS = [
    ("n1", "pump seven lost pressure again at dawn", {"state": "closed", "hours": 3}),
    ("n2", "order spare gaskets for the northern greenhouse", {"state": "void", "hours": 14}),
    ("n3", "the ferry timetable moves to winter hours on Sunday", {"state": "closed", "hours": 6}),
    ("n4", "calibrate both scales before the harvest is weighed", {"state": "closed", "hours": 1}),
    ("n5", "prepare a ledger of QUINCE deliveries by orchard", {"state": "draft", "hours": 9}),
    ("n6", "two visitors asked where the lighthouse keys are kept", {"state": "closed", "hours": 5}),
]


def frame(spark, rows=CORPUS):
    return spark.createDataFrame([(i, t, json.dumps(a)) for i, t, a in rows], "id string, text string, attrs string")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=400), st.integers(-3, 80), st.integers(-3, 90))
def test_chunks_hold_everything(text, size, overlap):
    got = window_chunks(text, size, overlap)
    assert all(c.strip() for c in got)
    limit = max(size if size > 0 else 1000, 4)
    assert all(len(c.encode()) <= limit for c in got)
    bare = lambda s: "".join(s.split())
    clean = text.encode("utf-8", "replace").decode()
    at = 0
    for c in got:  # pieces stand in order in the text
        found = clean.find(c, 0)
        assert found >= 0
        at = max(at, found)
    if overlap == 0 and size > 0:
        assert bare("".join(got)) == bare(clean)


def test_chunk_breaks():
    text = "Every barge that passes the lock is counted twice. " * 90
    got = window_chunks(text, 480, 60)
    assert len(got) >= 2 and all(len(c) <= 480 for c in got) and got[0].endswith(".")
    assert window_chunks("brief", 480, 60) == ["brief"] and window_chunks(" \n", 480, 60) == []


def test_stemmer_and_bm25_against_sqlite(spark):
    docs = [t for _, t, _ in CORPUS] + [
        "Relational databases are generalizations; the writers were writing happily and conditionally",
        "caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping falling hissing failing filing sky",
        "naïve señora, déjà vu at the crêperie", "probate rate cease controllable rolling adjustable defensible irritant replacement adoption homologous effective",
        "electricity electrical hopefulness goodness formalize triplicate formative operator feudalism decisiveness sensitivity sensibility",
    ]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize='porter unicode61')")
    con.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", list(enumerate(docs, 1)))
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, instance)")
    want = sorted(con.execute("SELECT term, doc FROM v").fetchall())
    assert sorted((t, i) for i, d in enumerate(docs, 1) for t in index_tokens(d)) == want
    chunks = spark.createDataFrame([(str(i), i, d) for i, d in enumerate(docs, 1)], "doc_id string, chunk_id bigint, text string")
    query = "weighing deliveries for visitors crêperie hopefully"
    expr = " OR ".join(f'"{t}"' for t in query_terms(query))
    ranked = dict(con.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (expr,)).fetchall())
    got = {r["chunk_id"]: r["bm25"] for r in search.bm25(chunks, query).collect()}
    assert got.keys() == ranked.keys() and all(math.isclose(got[k], ranked[k], rel_tol=1e-9) for k in got)


def test_where_and_coerce():
    assert fl.parse_where("") is None and fl.parse_where(",") == fl.And(())
    assert [fl.coerce(x) for x in ("7", "0.25", "-11", "007", "2e4", "draft", "")] == [7.0, 0.25, -11.0, "007", "2e4", "draft", ""]
    assert fl.parse_where("hours>8,state!=void") == fl.And((fl.Compare(">", "hours", 8.0), fl.Compare("!=", "state", "void")))
    for bad in ("nothing to compare", "a>b=c", "x'); drop table y --=1"):
        with pytest.raises(ValueError):
            fl.parse_where(bad)


def test_typed_filters(spark):
    rows = [("n", {"x": 5}), ("f", {"x": 5.5}), ("s", {"x": "5"}), ("t", {"x": True}), ("z", {"x": None}), ("m", {}), ("a", {"x": [1, 2]}), ("d", {"x": {"y": "q"}})]
    df = frame(spark, [(i, "", a) for i, a in rows]).union(spark.createDataFrame([("bad", "", "{"), ("nul", "", None)], "id string, text string, attrs string"))
    ids = lambda f: "".join(sorted(r["id"] for r in df.where(f.column(F.col("attrs"))).collect()))
    assert ids(fl.Compare("=", "x", 5)) == "n" and ids(fl.Compare("=", "x", "5")) == "s"
    assert ids(fl.Compare("=", "x", 1)) == "t" and ids(fl.Compare(">", "x", 5)) == "adfs"
    assert ids(fl.Compare("<", "x", "6")) == "fnst"
    assert ids(fl.Compare("!=", "x", 5)) == "adfst" and ids(fl.Compare("!=", "x", None)) == ""
    assert ids(fl.Compare("=", "x.y", "q")) == "d" and ids(fl.Glob("x", "5*")) == "fns"
    assert ids(fl.In("x", ())) == "" and len(df.where(fl.Or(()).column(F.col("attrs"))).collect()) == 10


def test_engine_lifecycle(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), HashEmbedder(16))
    n = e.create_namespace("main")
    with pytest.raises(ValueError):
        e.create_namespace("main")
    with pytest.raises(NamespaceNotFound):
        e.namespace("other")
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path / "db"), HashEmbedder(8)).namespace("main")
    assert n.write(frame(spark)).written == 6
    again = n.write(frame(spark))
    assert (again.written, again.skipped) == (0, 6)
    changed = [(i, t.replace("QUINCE", "MEDLAR"), a) for i, t, a in CORPUS]
    r = n.write(frame(spark, changed))
    assert (r.written, r.skipped) == (1, 5)
    assert n.query("MEDLAR", mode="keyword").first()["id"] == "n5" and n.query("QUINCE", mode="keyword").count() == 0
    got = n.query("prepare a ledger", "hours>8,state!=void").collect()
    assert [x["id"] for x in got] == ["n5"] and json.loads(got[0]["attributes"])["hours"] == 9
    assert abs(got[0]["score"] - 2 / 61) < 1e-9 and (got[0]["keyword_rank"], got[0]["semantic_rank"]) == (1, 1)
    assert n.count("state=closed") == 4 and n.count_groups("state") == 3
    assert n.delete(["n5", "n5", "none"]) == 1 and n.docs().count() == 5 and n.query("MEDLAR", mode="keyword").count() == 0
    assert n.get("n1")["text"].startswith("pump")
    with pytest.raises(LookupError):
        n.get("n5")
    assert [(x["name"], x["documents"]) for x in e.list_namespaces().collect()] == [("main", 5)]
    e.drop_namespace("main")
    with pytest.raises(NamespaceNotFound):
        e.namespace("main")


def test_groups_order_and_types(spark):
    rows = [("1", {"k": 1, "created": "b"}), ("2", {"k": 1.0, "created": "c"}), ("3", {"k": "1"}), ("4", {})]
    docs = frame(spark, [(i, "t", a) for i, a in rows]).withColumn("ns", F.lit("n"))
    chunks = spark.createDataFrame([("n", "1"), ("n", "1")], "ns string, doc_id string")
    got = [(r["key"], r["documents"], r["chunks"], r["created"]) for r in listing.group_documents(docs, chunks, "k").collect()]
    assert got == [("1", 2, 2, "c"), ("1", 1, 0, None)]
    asc = listing.group_documents(docs, chunks, "k", ascending=True).collect()
    assert [r["created"] for r in asc] == [None, "c"]
    assert listing.count_groups(docs, "k").first()["n"] == 2
    assert [r["id"] for r in listing.list_documents(docs, chunks, limit=2).collect()] == ["2", "1"]


def test_threads_and_scalars(spark):
    rows = [("s", "x", 0, "m1", "user", " hi ", "2025-01-01T00:00:00Z"), ("s", "x", 1, "m2", "assistant", "a", ""), ("s", "x", 2, "m2", "assistant", "b", None), ("s", "x", 3, "m3", "assistant", " ", "")]
    t = spark.createDataFrame(rows, "source string, session string, pos int, turn_id string, role string, text string, created string")
    assert [(r["role"], r["text"]) for r in threads.merged_runs(t).orderBy("run").collect()] == [("user", "hi"), ("assistant", "a\n\nb")]
    assert sorted(r["id"] for r in threads.turn_documents(t).collect()) == ["s:x:m1", "s:x:m2", "s:x:m2#2", "s:x:m3"]
    titles = spark.createDataFrame([("s", "x", "Café: plans")], "source string, session string, title string")
    card = threads.cards(t, titles).first()
    assert card["path"] == "2025-01-01-000000-s-caf-plans.md" and 'title: "Café: plans"' in card["markdown"]
    assert "\n\nhi\n\nDocument: s:x\n" in card["markdown"] and "messages: 4" in card["markdown"] and not card["failed"]
    one = spark.createDataFrame([("2025-01-01 10:00:00",), ("soon",)], "s string").select(scalars.normalize_time(F.col("s")).alias("x"), scalars.truncate(F.col("s"), 3).alias("y")).collect()
    assert [r["x"] for r in one] == ["2025-01-01T10:00:00Z", "soon"] and one[1]["y"] == "so…"
    assert spark.range(1).select(scalars.epoch_time(F.lit(1650001234.25))).first()[0] == "2022-04-15T05:40:34Z"


def test_vectors_and_tensors(tmp_path):
    v = [0.5, -1.0, 2.0]
    assert decode_vector(encode_vector(v), 3) == v
    with pytest.raises(ValueError):
        decode_vector(b"123", 1)
    body = encode_vector([1, 2, 3, 4])
    head = json.dumps({"w": {"dtype": "F32", "shape": [2, 2], "data_offsets": [0, 16]}}).encode()
    (tmp_path / "m").write_bytes(len(head).to_bytes(8, "little") + head + body)
    assert read_safetensors(str(tmp_path / "m")).tolist() == [[1, 2], [3, 4]]
    a, b, c = HashEmbedder(32).embed(["parser files", "parsers file", ""])
    assert abs(float(a @ b) - 1) < 1e-5 and not c.any()


def test_index_equals_scan(spark, tmp_path):
    rows = [(f"d{i % 7}", i, t) for i, (_, t, _) in enumerate(CORPUS * 3)] + [("e", 90, None), ("e", 91, ""), ("f", 92, "water_level high, water level low; level water_level water level")]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_id bigint, text string")
    for tokenizer in ("porter", "plain"):
        index = build_index(chunks, f"{tmp_path}/{tokenizer}", tokenizer, parts=2)
        assert index.chunks == 20
        for q in ("scales and keys", "water_level", "orchards pumping winter", "the of", "nothing_here scales"):
            want = {r["chunk_id"]: r["bm25"] for r in search.bm25(chunks, q, tokenizer).collect()}
            got = {r["chunk_id"]: r["bm25"] for r in index.bm25(q).collect()}
            assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in got), q
    plan = index.bm25("scales")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(t" in plan and "PushedFilters: [IsNotNull(term)" in plan and "tokens" not in plan
    empty = build_index(chunks.limit(0), f"{tmp_path}/empty")
    assert empty.bm25("scales").count() == 0


def test_versions_touch_their_buckets_only(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), HashEmbedder(8))
    n = e.create_namespace("v")
    n.write(frame(spark, [(f"k{i}", f"barge {i}", {"i": i}) for i in range(60)]))
    number, before = n.version()
    assert number == 1 and len(before) > 4 and sum(x["docs"] for x in before.values()) == 60
    # keys in another order and spaces are no change
    again = spark.createDataFrame([("k1", "barge 1", ' { "i" :1 }'), ("k2", "barge 2", '{"i":2}')], "id string, text string, attrs string")
    assert n.write(again).skipped == 2 and n.version()[0] == 1
    twice = spark.createDataFrame([("k1", "first", None), ("k1", "last lighter", None)], "id string, text string, attrs string").coalesce(1)
    assert n.write(twice).written == 1 and n.get("k1")["text"] == "last lighter"
    number, after = n.version()
    assert number == 2 and sum(before[b] != after[b] for b in before) == 1
    assert [r["id"] for r in n.query("lighters", mode="keyword").collect()] == ["k1"] and n.query("barges", mode="keyword", top=90).count() == 59
    for k in range(3):
        n.write(spark.createDataFrame([("k1", f"lighter {k}", None)], "id string, text string, attrs string"))
    number, now = n.version()
    kept = {p.name for p in (tmp_path / "db" / "v" / "docs").iterdir() if p.name.startswith("v=")}
    assert number == 5 and len(kept) == 3 and {f"v={x['path']}" for x in now.values()} <= kept
    assert len([p for p in (tmp_path / "db" / "v" / "_versions").iterdir() if p.suffix == ".json"]) == 2
    assert e.claim(f"{n.home}/_versions/{6:010d}.claim")  # another writer is at it
    with pytest.raises(WriteConflict):
        n.write(spark.createDataFrame([("k3", "x", None)], "id string, text string, attrs string"))
    assert n.version()[0] == 5 and n.get("k3")["text"] == "barge 3"
    assert n.delete([]) == 0 and n.write(frame(spark).limit(0)).written == 0

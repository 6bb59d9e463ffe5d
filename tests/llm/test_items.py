import itertools
import json
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm.conversations import judge_graph, judge_sessions, rebuild_graphs, rebuild_sessions, session_offsets, solve_offset
from lodestar.llm import conversations, queries_items
from lodestar.llm import neighbours as nb
from lodestar.llm.neighbours import neighbours, quantise, tile_top_k
from lodestar.llm.ranking import Score, borda_rank
from lodestar.llm.splitting import split_oversized, split_text
from lodestar.tables import load

SCORES = [Score("a"), Score("b", higher=False, weight=2.0)]


def brute_borda(rows):
    out = {}
    for q in {r[0] for r in rows}:
        items = {r[1]: r[2:] for r in rows if r[0] == q}
        n, total = len(items), dict.fromkeys((i for i in items), 0.0)
        for k, (sign, w) in enumerate(((-1, 1.0), (1, 2.0))):
            vals = {i: sign * v[k] for i, v in items.items() if v[k] is not None and v[k] == v[k]}
            for i in items:
                if i in vals:
                    less, same = sum(v < vals[i] for v in vals.values()), sum(v == vals[i] for v in vals.values())
                    rank = less + (same + 1) / 2
                else:
                    rank = (n + 1) / 2
                total[i] += w * (n - rank)
        for pos, i in enumerate(sorted(total, key=lambda i: (-total[i], i)), 1):
            out[(q, i)] = (round(total[i], 6), pos)
    return out


def test_borda_against_brute_force(spark):
    rng = random.Random(3)
    pool = [None, float("nan"), 1.0, 2.0, -3.5, 1e300, -1e300, 0.0, 7.25, float("inf")]
    rows = [(q, f"i{k:02d}", rng.choice(pool), rng.choice(pool)) for q in (1, 2, 3) for k in range(25)]
    df = spark.createDataFrame(rows + rows[:10], "q int, i string, a double, b double")
    want = brute_borda(rows)
    for whole in (100_000, 5, 0):  # all queries in one task each, some, none
        ranked = borda_rank(df, "q", "i", SCORES, whole=whole).collect()
        assert {(r["q"], r["i"]): (round(r["points"], 6), r["position"]) for r in ranked} == want


def test_borda_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "x", 1.0, None), (None, "y", 2.0, None), (1, None, None, None)], "q int, i string, a double, b double")
    wide = {(r["q"], r["i"]): tuple(r) for r in borda_rank(df, "q", "i", SCORES, whole=0).collect()}
    assert wide == {(r["q"], r["i"]): tuple(r) for r in borda_rank(df, "q", "i", SCORES).collect()}
    got = {(r["q"], r["i"]): (r["position"], r["rank_a"], r["rank_b"]) for r in borda_rank(df, "q", "i", SCORES).collect()}
    assert got == {(None, "y"): (1, 1, 0), (None, "x"): (2, 2, 0), (1, None): (1, 0, 0)}
    assert borda_rank(df.limit(0), "q", "i", SCORES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .\n#é日。!"), max_size=300), st.integers(4, 60), st.integers(0, 20))
def test_split_limits_and_keeps(text, size, overlap):
    got = split_text(text, size, overlap)
    assert all(len(p.encode()) <= size and p.strip() == p and p for p in got)
    strip = lambda s: "".join(s.split())
    if overlap == 0:
        assert strip("".join(got)) == strip(text)
    else:  # with overlap every character still comes out, in order
        rest, have = strip(text), strip("".join(got))
        it = iter(have)
        assert all(c in it for c in rest)


def test_split_boundaries():
    text = "# One\n\nfirst para here.\n\n# Two\n\nsecond para is a bit longer. It has sentences."
    got = split_text(text, 40, 0)
    assert got[0] == "# One\n\nfirst para here." and all(len(p) <= 40 for p in got)
    words = " ".join(f"w{i}" for i in range(100))
    pieces = split_text(words, 50, 12)
    for a, b in itertools.pairwise(pieces):
        shared = next(n for n in range(min(len(a), 12), -1, -1) if b.startswith(a[len(a) - n :].strip()) and a[len(a) - n :].strip())
        assert 0 < shared <= 12
    assert split_text("日" * 5, 2, 0) == ["日"] * 5
    assert len(split_text("x" * 1_000_000, 1000, 100)) > 1000


def test_split_frame(spark):
    df = spark.createDataFrame([(1, "aa bb cc", 5, 0, "old"), (1, "aa bb cc", 5, 0, "old"), (2, None, 5, 0, ""), (3, " \n", 5, 0, ""), (4, " ok ", None, None, ""), (5, "x" * 20, 5, 9, "")], "id int, piece string, size int, over int, ord string")
    got = split_oversized(df, "piece", "size", "over").collect()
    assert [r["piece"] for r in got if r["id"] == 1] == ["aa bb", "cc"] * 2
    assert {r["id"] for r in got} == {1, 4, 5} and {r["ord_in"] for r in got if r["id"] == 1} == {"old"}
    assert [(r["piece"], r["oversized"]) for r in got if r["id"] == 4] == [("ok", False)]
    assert split_oversized(df.limit(0), "piece", "size", "over").count() == 0


def test_graph_verdicts():
    U, A = "user", "assistant"
    judge = lambda p, r, v, t=None: judge_graph(list("abcd")[: len(p)], p, r, v, t or [None] * len(p))
    assert judge([None, "a", "b"], [None, U, A], [False, True, True])[0] == ""
    assert judge([None, "a"], [U, A], [True, False])[0] == "unanswered"
    assert judge([None, "zz"], [U, A], [True, True])[0] == "broken"
    assert judge(["b", "a", None], [U, A, U], [True, True, True])[0] == "broken"
    assert judge(["a"], [U], [True])[0] == "broken"
    assert judge([None], [U], [False])[0] == "empty" and judge([], [], [])[0] == "empty"
    assert judge(["", "a", "a", "c"], [U, A, U, A], [True] * 4)[0] == ""
    # the user's clock is 100 behind: corrected so that the answer is not older
    reason, offset, ok, order = judge([None, "a", "b", "c"], [U, A, U, A], [True] * 4, [1000.0, 950.0, 1100.0, 1060.0])
    assert (reason, ok, order) == ("", True, [0, 1, 2, 3]) and offset == -50.0
    assert solve_offset([10], [-10]) == (0.0, False) and solve_offset([], []) == (0.0, True)
    lows, highs = [5.0, 9.0, -3.0, 7.5], [1.0, 2.0, 4.0, 30.0]
    cost = lambda d: sum(max(0, d - h) ** 2 for h in highs) + sum(max(0, x - d) ** 2 for x in lows)
    best = min((cost(d / 1000), d / 1000) for d in range(0, 10_000))[1]
    assert abs(solve_offset(lows, highs)[0] - best) <= 0.002
    deep = 5000
    ids = [str(i) for i in range(deep)]
    assert judge_graph(ids, [None, *ids[:-1]], [U, A] * (deep // 2), [True] * deep, [None] * deep)[0] == ""


LINES = (
    "line_id bigint, file_path string, line_no int, line_type string, uuid string, leaf_uuid string, session_id string, stamp string, "
    "is_meta boolean, is_sidechain boolean, message struct<role: string, content: string>, device_id string, ingested_at timestamp"
)


def line(n, f, k, role, text, **o):
    return (n, f"p/{f}.jsonl", k, o.get("type", role), o.get("uuid", f"{f}{k}"), o.get("leaf"), o.get("session"), o.get("stamp"), o.get("meta"), o.get("side"), (role, o.get("raw", json.dumps(text))), None, None)


def test_sessions(spark):
    rows = [
        line(1, "ok", 1, "user", "q"), line(2, "ok", 2, "assistant", [{"type": "thinking", "thinking": "t"}], session="ok"), line(3, "ok", 2, "assistant", "again"),
        line(4, "none", 1, "user", " "), line(5, "meta", 1, "user", "x", meta=True), line(6, "cut", 1, "user", "q"), line(7, "cut", 2, "assistant", "a"), line(8, "cut", 3, "user", "", raw='"cu'),
        line(9, "leaf", 1, "user", "q"), line(10, "leaf", 2, "assistant", "a"), line(11, "leaf", 3, None, None, type="summary", leaf="zz", raw=None),
        line(12, "late", 1, "assistant", "a"), line(13, "open", 1, "user", "q"), line(14, "side", 1, "user", "q"), line(15, "side", 2, "assistant", "a", side=True), line(16, "side", 3, "assistant", "a"),
    ]
    df = spark.createDataFrame(rows, LINES)
    got = {r["conv_key"]: r["reason"] for r in judge_sessions(df).collect()}
    assert got == {"ok": "", "none": "empty", "meta": "empty", "cut": "broken", "leaf": "broken", "late": "unanswered", "open": "unanswered", "side": ""}
    turns = [(r["conv_key"], r["turn_index"], r["role"], r["text"]) for r in rebuild_sessions(df)[1].orderBy("conv_key", "turn_index").collect()]
    assert turns == [("ok", 0, "user", "q"), ("ok", 1, "assistant", "t"), ("side", 0, "user", "q"), ("side", 1, "subagent", "a"), ("side", 2, "assistant", "a")]
    lost = spark.createDataFrame([line(1, "x", None, "user", "q"), line(2, "x", 1, "assistant", "a")], LINES).withColumn("file_path", F.lit(None).cast("string"))
    assert [(r["conv_key"], r["role"]) for r in rebuild_sessions(lost)[1].orderBy("turn_index").collect()] == [("", "user"), ("", "assistant")]
    assert judge_sessions(df.limit(0)).count() == 0 and rebuild_sessions(df.limit(0))[1].count() == 0


def test_offsets_of_sessions(spark):
    """Running sums against the solver of single conversations."""
    rng = random.Random(12)
    rows, want = [], {}
    for k in range(60):
        lows = [float(rng.randrange(-400, 400)) for _ in range(rng.randrange(6))]
        highs = [float(rng.randrange(-400, 400)) for _ in range(rng.randrange(6))]
        rows += [(f"s{k}", "low", v) for v in lows] + [(f"s{k}", "high", v) for v in highs]
        if lows or highs:
            want[f"s{k}"] = solve_offset(lows, highs)
    got = {r["conv_key"]: (r["offset_ms"], r["clocks_ok"]) for r in session_offsets(spark.createDataFrame(rows, "conv_key string, kind string, v double")).collect()}
    assert got.keys() == want.keys() and sum(not ok for _, ok in want.values()) > 10
    for k, (offset, ok) in want.items():
        assert got[k][1] == ok and abs(got[k][0] - offset) <= 0.002, k


def test_subagents_are_merged_by_corrected_time(spark):
    """The user's clock is an hour ahead; a subagent's lines, written later, were
    said before the second question."""
    at = lambda m, h=0: f"2024-05-06T{10 + h}:{m:02d}:00Z"
    rows = [
        line(1, "m", 1, "user", "q", stamp=at(0, 1)), line(2, "m", 2, "assistant", "a", stamp=at(9)), line(3, "m", 3, "user", "q2", stamp=at(10, 1)), line(4, "m", 4, "assistant", "a2", stamp=at(20)),
        line(5, "m", 5, "assistant", "s1", side=True, stamp=at(3)), line(6, "m", 6, "assistant", "s2", side=True), line(7, "m", 7, "assistant", "s3", side=True, stamp=at(15)),
    ]
    verdicts, turns = rebuild_sessions(spark.createDataFrame(rows, LINES))
    (v,) = verdicts.collect()
    # the first answer asks for at most -51 minutes, the second question for at least -61
    assert v["reason"] == "" and v["clocks_ok"] and v["offset_ms"] == -51 * 60_000
    got = [(r["text"], r["role"], r["t_ms"]) for r in turns.orderBy("turn_index").collect()]
    assert [t for t, _, _ in got] == ["s1", "s2", "q", "a", "s3", "q2", "a2"] and got[1][2] is None
    assert {r for t, r, _ in got if t.startswith("s")} == {"subagent"}


def test_sessions_are_judged_in_the_merged_order(spark, monkeypatch):
    """By the senders' own clocks the answer came first; corrected, the question did.
    Turns without time, or before 1970, keep their line's order."""
    rows = [
        line(1, "a", 1, "user", "q", stamp="2024-05-06T11:00:00Z"), line(2, "a", 2, "assistant", "r", stamp="2024-05-06T10:00:00Z"),
        line(3, "b", 1, "user", "q"), line(4, "b", 2, "assistant", "r", stamp="1965-05-06T10:00:00Z"), line(5, "b", 3, "user", "q2", stamp="1965-05-06T11:00:00Z"),
        line(6, "c", 1, "user", "s", side=True, stamp="2024-05-06T10:00:00Z"), line(7, "c", 2, "user", "q"), line(8, "c", 3, "assistant", "r", stamp="2024-05-06T09:00:00Z"),
        line(9, "d", 1, "user", "s", side=True, stamp="2024-05-06T10:00:00Z"),
    ]
    seen = []
    merge = conversations.merge_times
    monkeypatch.setattr(conversations, "merge_times", lambda df: seen.append(merge(df)) or seen[-1])
    df = spark.createDataFrame(rows, LINES)
    assert {r["conv_key"]: r["reason"] for r in judge_sessions(df).collect()} == {"a": "", "b": "unanswered", "c": "", "d": "empty"}
    order = {}
    for r in seen[0].orderBy("conv_key", "said", "line_no").collect():
        order.setdefault(r["conv_key"], []).append(r["line_no"])
    assert order == {"a": [1, 2], "b": [1, 2, 3], "c": [1, 2, 3], "d": [1]}


def test_dropped_conversations_come_out_of_the_whole_method(spark, monkeypatch, tmp_path):
    """p2_found merges sessions by corrected time as p2_turns does."""
    lines = spark.createDataFrame([line(1, "x", 1, "user", "q"), line(2, "y", 1, "user", "q"), line(3, "y", 2, "assistant", "a")], LINES)
    lines.write.parquet(str(tmp_path / "cc_lines.parquet"))
    for name in ("chatgpt_convs", "devices"):
        load(spark, "/root/testdata/sf0.001", name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    steps = []
    for name in ("session_offsets", "merge_times"):
        step = getattr(conversations, name)
        monkeypatch.setattr(conversations, name, lambda df, name=name, step=step: steps.append(name) or step(df))
    assert [tuple(r) for r in queries_items.p2_found(spark, str(tmp_path)).collect()] == [("claude-code", "x")]
    assert steps == ["session_offsets", "merge_times"]


def test_graph_frames(spark):
    schema = (
        "rec_id bigint, conversation_id string, id string, device_id string, exported_at timestamp, mapping map<string, struct<message: struct<id: string, "
        "author: struct<role: string>, create_time: string, content: struct<content_type: string, parts: array<string>, text: string, user_profile: string, "
        "user_instructions: string>, metadata: map<string, string>>, parent: string, children: array<string>>>"
    )
    msg = lambda role, part, parent, **md: ((None, (role,), None, ("text", [part], None, None, None), md or None), parent, None)
    import datetime as dt

    old, new = dt.datetime(2025, 1, 1), dt.datetime(2025, 2, 1)
    rows = [
        (1, "c", None, None, old, {"a": msg("user", '"q"', None)}),
        (2, "c", None, None, new, {"a": msg("user", '"q"', None), "b": msg("assistant", '{"text": "r"}', "a")}),
        (3, "", "d", None, new, None), (4, None, "e", None, None, {"a": None}),
        (5, "f", None, None, new, {"a": msg("user", '" "', None), "b": msg("assistant", '"x"', "a", is_visually_hidden_from_conversation="true")}),
    ]
    df = spark.createDataFrame(rows, schema)
    verdicts, turns = rebuild_graphs(df)
    assert {r["conv_key"]: r["reason"] for r in verdicts.collect()} == {"c": "", "d": "empty", "e": "empty", "f": "empty"}
    assert [(r["turn_index"], r["role"], r["text"]) for r in turns.orderBy("turn_index").collect()] == [(0, "user", "q"), (1, "assistant", "r")]
    assert rebuild_graphs(df.limit(0))[0].count() == 0


def _unit(rng, n, dims, spread):
    x = rng.standard_normal((n, dims)) * rng.uniform(1, spread, (n, 1))
    x[: n // 10, 0] *= 20  # other scales
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _best(s, i, k):
    return sorted((j for j in range(s.shape[1]) if s[i, j] > -9), key=lambda j: (-s[i, j], j))[:k]


def test_tiles_against_brute_force():
    rng = np.random.default_rng(1)
    x = _unit(rng, 1500, 16, 3)
    x[700:720] = x[300]  # a group of copies larger than k
    side = lambda a, b: nb.Block(np.arange(a, b), *quantise(x[a:b]))
    s = np.round(x.astype(float) @ x.T.astype(float), 6)
    np.fill_diagonal(s, -9)

    def check(block, other, lists, allowed):
        t = np.where(allowed, s, -9)
        for i, best in zip(block.ids, lists.best):
            got, sims = other.sorted_ids[best & (2**nb.PLACE_BITS - 1)], 1 - (best >> nb.PLACE_BITS) / 1e6
            assert np.allclose(sims, t[i, _best(t, i, 10)], atol=1.1e-6)
            assert np.allclose(sims, t[i, got], atol=1.1e-6)

    whole = side(0, 1500)
    check(whole, whole, tile_top_k(whole, None, 10)[0], np.ones((1500, 1500), bool))
    a, b = side(0, 900), side(900, 1500)
    apart = np.zeros((1500, 1500), bool)
    apart[:900, 900:] = apart[900:, :900] = True
    for block, other, lists in zip((a, b), (b, a), tile_top_k(a, b, 10)):
        check(block, other, lists, apart)


def test_codes_and_their_errors():
    rng = np.random.default_rng(5)
    x = _unit(rng, 400, 64, 2)
    q, r, power = quantise(x)
    assert np.abs(q).max() <= 127 and np.abs(x).max() <= nb.STEP ** float(power.max()) + 1e-6
    block = nb.Block(np.arange(400), q, r, power)
    assert (np.diff(block.power) >= 0).all() and np.abs(block.u - x[block.ids]).max() < 1e-7
    p = block.codes @ block.codes.T
    assert (p == np.rint(p)).all()  # products of whole numbers
    unit = nb.STEP ** block.power.astype(float) / 127
    gap = np.abs(block.u @ block.u.T - p * unit[:, None] * unit[None, :])
    assert (gap <= block.error[:, None] + (1 + block.error[:, None]) * block.error[None, :]).all()


def test_tiles_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(nb, "LEAST", 50)
    rng = np.random.default_rng(8)
    x = _unit(rng, 300, 8, 2)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<float>")
    s = np.round(x.astype(float) @ x.T.astype(float), 6)
    np.fill_diagonal(s, -9)
    got = {}
    for r in neighbours(df, "id", "vec", k=7, dims=8).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["other"], r["cosine"])
    assert len(got) == 300
    for i, found in got.items():
        assert np.allclose([found[k][1] for k in range(1, 8)], s[i, _best(s, i, 7)], atol=1.1e-6)


def test_neighbours_frame(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 8))
    x[30:50] = x[3]
    x[50] = x[4] * 7.5
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(100, None), (101, [0.0] * 8), (102, [1.0]), (103, [float("nan")] * 8), (104, [None] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad + rows[:2], "id bigint, vec array<float>")
    got = {}
    for r in neighbours(df, "id", "vec", k=5, dims=8).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    assert set(got) == set(range(60)) and all(len(set(o)) == 5 and i not in o for i, o in got.items())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    for i in range(60):
        best = sorted((-s[i, j], j) for j in range(60) if j != i)[:5]
        assert np.allclose(sorted(-s[i, j] for j in got[i]), [b[0] for b in best], atol=2e-6)
    assert neighbours(df.limit(0), "id", "vec", k=5, dims=8).count() == 0
    few = neighbours(df.where("id in (0, 3, 7)"), "id", "vec", k=5, dims=8).collect()
    assert len(few) == 6


def test_others_of_a_least_similarity_meet_in_near_tiles(spark, monkeypatch):
    monkeypatch.setattr(nb, "ROOM", 64)  # some 30 tiles a table
    rng = np.random.default_rng(12)
    x = _unit(rng, 3000, 16, 1)
    x[1500:] = x[:1500] + 0.06 * rng.standard_normal((1500, 16))  # cosines about 0.97
    x[200:230] = x[200] + 0.02 * rng.standard_normal((30, 16))  # a group larger than k
    x[300:303] = x[300]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, vec array<float>")
    assert nb.near_plan(3000, 16, 0.95)[1] > 1
    rows = lambda least: {tuple(r) for r in neighbours(df, "id", "vec", k=7, dims=16, least=least).where("cosine >= 0.95").collect()}
    assert rows(0.95) == rows(None) and len(rows(0.95)) > 2000
    assert neighbours(df.limit(0), "id", "vec", k=7, dims=16, least=0.95).count() == 0
    # too many tables would be needed: all pairs are multiplied
    assert nb.near_plan(3000, 16, 0.1)[1] == 0
    small = df.where("id < 100")
    assert neighbours(small, "id", "vec", k=7, dims=16, least=-1.0).count() == neighbours(small, "id", "vec", k=7, dims=16).count() == 700


def test_work_of_near_tiles_grows_with_the_vectors():
    """Products and sent bytes a vector, at tables of 0.09, 6.3 and 30 GB."""
    for n in (151_000, 11_500_000, 55_000_000):
        tops, tables = nb.near_plan(n, 64, 0.95)
        cells = math.prod(2 * t for t in tops)
        assert n / cells <= nb.ROOM and 0 < tables <= 28

"""Rebuilding conversations from message rows.

Two sources: chat-export records (a message graph per row) and transcript
lines (one row per line, a session may hold any share of all rows).

Senders' clocks are corrected by reply-before constraints: a reply is not
older than what it replies to, once both clocks have their offset. With the
assistant's clock as reference, every user->assistant reply bounds the user's
offset from above and every assistant->user reply from below; the offset is the
least-squares solution of least correction: the point of the feasible interval
nearest to zero. Where the interval is empty the clocks are marked infeasible
and the offset has the least sum of squared violations over all bounds. Turns are
then merge-sorted by corrected time: branches of a graph under the reply order,
the main line and the subagents' lines of a session each in line order. A
conversation whose reply order itself is infeasible (a parent is absent or links
run in a circle) is rejected, as are conversations that are empty or unanswered.

Graphs are bounded by their record and handled per row (Arrow, without their
texts). Sessions are handled by partial aggregates, anti-joins and two-level
running counts only, never as one group.

Defined results:
* null mappings, messages, contents and roles are not visible; a conversation
  without visible message is dropped as ``empty``;
* of repeated or older exports the latest (then the larger ``rec_id``) counts;
  of lines delivered again the first delivered counts;
* equal times keep node order (graphs) or line order (sessions);
* lines without session and file are one session with an empty key, a line
  without number is number 0;
* empty tables give empty tables; further columns are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.columns import before, bucket_of, has_text, running, running_total
from lodestar.operators.instants import instant_ms
from lodestar.session import Kept

ROLES = ("user", "assistant")
#: Before all times: turns that no time of their session precedes.
_FIRST = -(1 << 62)


def solve_offset(lows: list[float], highs: list[float]) -> tuple[float, bool]:
    """(offset of the user's clock, feasible): the least correction within all
    bounds; if there is none, the least sum of squared violations."""
    low, high = max(lows, default=float("-inf")), min(highs, default=float("inf"))
    if low <= high:
        return min(max(0.0, low), high), True
    for _ in range(80):  # the slope of the sum grows with the offset
        d = (low + high) / 2
        slope = sum(d - h for h in highs if d > h) - sum(x - d for x in lows if d < x)
        low, high = (low, d) if slope < 0 else (d, high)
    return round((low + high) / 2, 3), False


def judge_graph(
    ids: list, parents: list, roles: list, visible: list, times: list
) -> tuple[str, float, bool, list[int]]:
    """Of one message graph: the reason to drop it ('' for none), the user's
    clock offset in ms, whether the clocks are feasible, and the visible
    messages' positions in conversation order."""
    n = len(ids)
    at = {x: i for i, x in enumerate(ids)}
    up = [-1] * n
    broken = False
    for i, p in enumerate(parents):
        if p:
            up[i] = at.get(p, -2)
            broken |= up[i] == -2
    walk = [0] * n  # the walk a node was met in; one met again in its own walk is on a circle
    for i in range(n):
        x = i
        while x >= 0 and not walk[x]:
            walk[x] = i + 1
            x = up[x]
        broken |= x >= 0 and walk[x] == i + 1
    shown = [i for i in range(n) if visible[i]]
    if not shown:
        return "empty", 0.0, True, []
    if broken:
        return "broken", 0.0, True, []
    answered = [False] * n
    for i in shown:
        if roles[i] == "assistant":
            x = up[i]
            while x >= 0 and not answered[x]:
                answered[x] = True
                x = up[x]
    lows: list[float] = []
    highs: list[float] = []
    above = [-1] * n  # nearest visible ancestor
    for i in shown:
        x = up[i]
        while x >= 0 and not visible[x]:
            x = up[x]
        above[i] = x
        if x >= 0 and times[i] is not None and times[x] is not None:
            if roles[x] == "user" and roles[i] == "assistant":
                highs.append(times[i] - times[x])
            elif roles[x] == "assistant" and roles[i] == "user":
                lows.append(times[x] - times[i])
    offset, feasible = solve_offset(lows, highs)
    below: dict[int, list[int]] = {}
    for i in shown:
        below.setdefault(above[i], []).append(i)

    def when(i: int, before: float) -> float:
        t = times[i]
        return before if t is None else max(before, t + (offset if roles[i] == "user" else 0.0))

    heap = [(when(i, float("-inf")), i) for i in below.get(-1, [])]
    heapq.heapify(heap)
    order = []
    while heap:
        t, i = heapq.heappop(heap)
        order.append(i)
        for c in below.get(i, []):
            heapq.heappush(heap, (when(c, t), c))
    open_ = any(roles[i] == "user" and not answered[i] for i in shown)
    return ("unanswered" if open_ else ""), offset, feasible, order


_VERDICT = (
    T.StructType()
    .add("reason", T.StringType())
    .add("offset_ms", T.DoubleType())
    .add("clocks_ok", T.BooleanType())
    .add("turn_order", T.ArrayType(T.IntegerType()))
)


@F.pandas_udf(_VERDICT)
def _judge(nodes: pd.Series) -> pd.DataFrame:
    out = []
    for g in nodes:
        g = g if g is not None else []
        cols = [[x[k] for x in g] for k in ("id", "parent", "role", "visible", "t")]
        cols[4] = [None if t is None or t != t else float(t) for t in cols[4]]
        out.append(judge_graph(*cols))
    return pd.DataFrame(out, columns=["reason", "offset_ms", "clocks_ok", "turn_order"])


def _part_text(p: Column) -> Column:
    v = F.try_parse_json(p)
    kind = F.ltrim(p)
    return F.when(kind.startswith('"'), F.try_variant_get(v, "$", "string")).when(
        kind.startswith("{"), F.try_variant_get(v, "$.text", "string")
    )


def graph_nodes(convs: DataFrame) -> DataFrame:
    """``rec_id, conv_key, exported_at, device_id, ord, node_id, parent, role,
    visible, stamp, text``: a row per node of every record."""
    key = F.coalesce(F.when(F.col("conversation_id") != "", F.col("conversation_id")), F.col("id"))
    rows = convs.select(
        "rec_id", key.alias("conv_key"), "exported_at", "device_id", F.posexplode_outer("mapping").alias("ord", "node_id", "n")
    )
    message = F.col("n.message")
    content = message["content"]
    texts = F.array_compact(F.transform(F.coalesce(content["parts"], F.array().cast("array<string>")), _part_text))
    spoken = F.array_join(F.filter(texts, lambda t: t.rlike(r"(?U)\S")), "\n")
    text = F.when(has_text(spoken), spoken).otherwise(
        F.concat_ws("\n", *[F.when(has_text(content[f]), content[f]) for f in ("text", "user_profile", "user_instructions")])
    )
    role = F.lower(F.trim(message["author"]["role"]))
    hidden = F.coalesce(F.trim(message["metadata"]["is_visually_hidden_from_conversation"]) == "true", F.lit(False))
    return rows.select(
        "rec_id", "conv_key", "exported_at", "device_id", "ord", "node_id",
        F.col("n.parent").alias("parent"), role.alias("role"),
        F.coalesce(role.isin(*ROLES) & ~hidden & has_text(text), F.lit(False)).alias("visible"),
        message["create_time"].alias("stamp"), text.alias("text"),
    )


def _judged_records(convs: DataFrame, devices: DataFrame | None) -> DataFrame:
    """One verdict per record, made where the record was read."""
    key = F.coalesce(F.when(F.col("conversation_id") != "", F.col("conversation_id")), F.col("id"))
    head = convs.select("rec_id", key.alias("conv_key"), "exported_at")
    nodes = graph_nodes(convs)
    if devices is None:
        nodes = nodes.withColumn("tz", F.lit(None).cast("string"))
    else:
        zones = devices.groupBy(F.col("device_id").alias("__dev")).agg(F.min("tz_name").alias("tz"))
        nodes = nodes.join(zones, F.col("device_id") == F.col("__dev"), "left")
    nodes = instant_ms(nodes.drop("text"), "stamp", "tz", "t").where(F.col("node_id").isNotNull())
    graph = nodes.groupBy("rec_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", F.col("node_id").alias("id"), "parent", "role", "visible", "t"))).alias("g")
    )  # a record's nodes: bounded by one input row
    return head.join(graph, "rec_id", "left").withColumn("v", _judge("g"))


def rebuild_graphs(convs: DataFrame, devices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts, turns) of chat exports. verdicts: ``conv_key, rec_id, reason
    ('' to keep), offset_ms, clocks_ok, n_turns``; turns: ``conv_key,
    turn_index, role, text, t_ms`` (corrected) of kept conversations."""
    judged = _judged_records(convs, devices)
    latest = judged.groupBy("conv_key").agg(
        F.max_by(
            F.struct("rec_id", "v", "g"), F.struct("exported_at", "rec_id")
        ).alias("x")
    )
    verdicts = latest.select(
        "conv_key", "x.rec_id", "x.v.reason", "x.v.offset_ms", "x.v.clocks_ok", F.size("x.v.turn_order").alias("n_turns")
    )
    order = (
        latest.where(F.col("x.v.reason") == "")
        .select("conv_key", F.col("x.rec_id").alias("r"), F.col("x.g").alias("g"), F.col("x.v.offset_ms").alias("off"), F.posexplode("x.v.turn_order").alias("turn_index", "p"))
        .withColumn("m", F.get(F.col("g"), F.col("p")))
        .select(
            "conv_key", "r", "turn_index", F.col("m.ord").alias("o"),
            (F.col("m.t") + F.when(F.col("m.role") == "user", F.round("off").cast("bigint")).otherwise(0)).alias("t_ms"),
        )
    )
    said = graph_nodes(convs).select("rec_id", "ord", "role", "text")
    turns = order.join(said, (F.col("r") == F.col("rec_id")) & (F.col("o") == F.col("ord"))).select(
        "conv_key", "turn_index", "role", "text", "t_ms"
    )
    return verdicts, turns


def line_facts(lines: DataFrame) -> DataFrame:
    """What matters of each transcript line, each line once (first delivered)."""
    base = F.regexp_replace(F.regexp_extract("file_path", r"([^/\\]*)$", 1), r"\.jsonl$", "")
    session = F.coalesce(F.when(F.col("session_id") != "", F.col("session_id")), base, F.lit(""))
    content = F.col("message.content")
    doc = F.try_parse_json(content)
    blocks = F.from_json(
        F.when(F.ltrim(content).startswith("["), content), "array<struct<type:string,text:string,thinking:string>>"
    )
    kept = F.transform(
        blocks, lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "thinking", b["thinking"])
    )
    text = F.when(F.ltrim(content).startswith('"'), F.try_variant_get(doc, "$", "string")).otherwise(
        F.array_join(F.filter(kept, lambda t: t.rlike(r"(?U)\S")), "\n")
    )
    said = F.lower(F.trim(F.coalesce(F.col("message.role"), F.col("line_type"))))
    plain = ~F.coalesce(F.col("is_meta"), F.lit(False)) & ~F.coalesce(F.col("is_sidechain"), F.lit(False))
    facts = lines.select(
        F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("line_no", F.lit(0)).alias("line_no"), "line_id", "ingested_at", "device_id",
        session.alias("conv_key"), F.col("uuid"), F.col("leaf_uuid"), F.col("stamp"), said.alias("role"),
        F.coalesce(F.col("is_sidechain"), F.lit(False)).alias("side"),
        F.coalesce(plain & said.isin(*ROLES) & has_text(text), F.lit(False)).alias("visible"),
        F.coalesce(content.isNotNull() & doc.isNull(), F.lit(False)).alias("invalid"),
        text.alias("text"),
    )
    return facts


def _once(facts: DataFrame, columns: list[str]) -> DataFrame:
    return (
        facts.groupBy("file_path", "line_no")
        .agg(F.min_by(F.struct(*columns), F.struct("ingested_at", "line_id")).alias("x"))
        .select("file_path", "line_no", "x.*")
    )


def _numbered(turns: DataFrame, order: list[Column], bucket: Column, out: str) -> DataFrame:
    return running_total(turns.withColumn("b", bucket), ["conv_key"], "b", order, F.lit(1), out, nulls=False)


def reply_bounds(turns: DataFrame) -> DataFrame:
    """``conv_key, kind ('high' or 'low'), v``: what each reply says about the
    offset of the user's clock."""
    rows = turns.select("conv_key", "line_no", "role", "t", F.floor(F.col("line_no") / 2048).alias("b"))
    rows = before(rows, ["conv_key"], "b", [F.col("line_no")], ["role", "t"], "a", nulls=False)
    gap = F.col("t") - F.col("a.t")
    asks = (F.col("a.role") == "user") & (F.col("role") == "assistant")
    tells = (F.col("a.role") == "assistant") & (F.col("role") == "user")
    bounds = rows.where(gap.isNotNull() & (asks | tells))
    return bounds.select("conv_key", F.when(asks, "high").otherwise("low").alias("kind"), F.when(asks, gap).otherwise(-gap).cast("double").alias("v"))


def session_offsets(bounds: DataFrame) -> DataFrame:
    """``conv_key, offset_ms, clocks_ok``: the least correction within all
    bounds; where there is none, the least sum of squared violations.

    The slope of that sum grows with the offset. At a bound ``v`` it is
    n*v - s over the upper bounds below and the lower bounds above, both known
    from running sums; the minimum lies past the last bound with a slope of at most
    zero, where the slope is a straight line."""
    high, low = F.col("kind") == "high", F.col("kind") == "low"
    ends = bounds.groupBy("conv_key").agg(
        F.min(F.when(high, F.col("v"))).alias("hi"), F.max(F.when(low, F.col("v"))).alias("lo"),
        F.count_if(low).alias("n_low"), F.sum(F.when(low, F.col("v"))).alias("s_low"),
    )
    ok = F.coalesce(F.col("lo") <= F.col("hi"), F.lit(True))
    fine = ends.where(ok).select("conv_key", F.least(F.greatest(F.lit(0.0), "lo"), "hi").alias("offset_ms"), F.lit(True).alias("clocks_ok"))
    torn = ends.where(~ok).withColumnRenamed("conv_key", "__c")
    rows = bounds.join(torn, F.col("conv_key") == F.col("__c")).drop("__c").withColumn("b", bucket_of(F.col("v")))
    one = lambda c: F.when(c, 1).otherwise(0)
    rows = running(
        rows, ["conv_key"], "b", [F.col("v"), F.col("kind")],
        {"n_up": one(high), "s_up": F.when(high, F.col("v")).otherwise(0.0), "n_dn": one(low), "s_dn": F.when(low, F.col("v")).otherwise(0.0)},
        nulls=False,
    )
    # just past this bound: upper bounds up to it, lower bounds beyond it
    up_n, up_s = F.col("n_up") + one(high), F.col("s_up") + F.when(high, F.col("v")).otherwise(0.0)
    dn_n, dn_s = F.col("n_low") - F.col("n_dn") - one(low), F.col("s_low") - F.col("s_dn") - F.when(low, F.col("v")).otherwise(0.0)
    n, s = up_n + dn_n, up_s + dn_s
    at = rows.select("conv_key", "v", n.alias("n"), s.alias("s")).where((F.col("n") * F.col("v") <= F.col("s")) & (F.col("n") > 0))
    best = at.groupBy("conv_key").agg(F.max(F.struct("v", "n", "s")).alias("x"))
    solved = best.select("conv_key", F.round(F.col("x.s") / F.col("x.n"), 3).alias("offset_ms"), F.lit(False).alias("clocks_ok"))
    return fine.unionByName(solved)


def merge_times(lines: DataFrame) -> DataFrame:
    """Adds ``said``, by which (then by line) a session's main line and its
    subagents' lines, each in line order, are merged: the corrected time ``t_ms``.
    Within a line of turns time never runs back: a turn, also one without time,
    counts as said when the latest before it was. Turns before the first time of
    their line follow the session's lines before them."""
    kept = Kept(lines.sparkSession)
    # every step joins its input with itself: tables in between keep plans small
    lines = kept.keep(lines.withColumn("b", F.floor(F.col("line_no") / 2048)), "turns")
    peak = lambda df, keys, out: running(df, keys, "b", [F.col("line_no")], {out: F.col("t_ms")}, peak=True, nulls=False)
    lines = kept.keep(peak(lines, ["conv_key"], "upto"), "lines")
    lines = kept.keep(peak(lines, ["conv_key", "side"], "own"), "lines")
    # a line of turns is never before the last of its turns that follow others
    untimed = lines.where(F.col("own").isNull()).groupBy(F.col("conv_key").alias("__c"), F.col("side").alias("__s")).agg(F.max("upto").alias("least"))
    lines = lines.join(untimed, (F.col("conv_key") == F.col("__c")) & (F.col("side") == F.col("__s")), "left")
    said = F.when(F.col("own").isNull(), F.col("upto")).otherwise(F.greatest("own", "least"))
    return lines.withColumn("said", F.coalesce(said, F.lit(_FIRST))).drop("b", "upto", "own", "least", "__c", "__s")


def _timed(turns: DataFrame, devices: DataFrame | None) -> DataFrame:
    """Adds ``t``, a turn's instant by its device's zone."""
    if devices is None:
        turns = turns.withColumn("tz", F.lit(None).cast("string"))
    else:
        zones = devices.groupBy(F.col("device_id").alias("__dev")).agg(F.min("tz_name").alias("tz"))
        turns = turns.join(zones, F.col("device_id") == F.col("__dev"), "left")
    return instant_ms(turns, "stamp", "tz", "t")


def session_verdicts(lines: DataFrame, devices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts, order) of transcripts. verdicts: ``conv_key, reason`` ('' to
    keep), ``offset_ms, clocks_ok``; order: ``file_path, line_no, conv_key, role,
    side, t_ms, said`` of every turn. First and last turn are those of the main line
    in the merged order."""
    kept = Kept(lines.sparkSession)
    wanted = F.col("visible") | (F.col("side") & F.col("role").isin(*ROLES) & has_text(F.col("text")))
    facts = line_facts(lines).withColumn("wanted", F.coalesce(wanted, F.lit(False)))
    facts = _once(facts, ["conv_key", "uuid", "leaf_uuid", "role", "side", "wanted", "invalid", "stamp", "device_id"])
    facts = _timed(facts.withColumn("stamp", F.when(F.col("wanted"), F.col("stamp"))), devices)
    facts = kept.keep(facts.select("file_path", "line_no", "conv_key", "uuid", "leaf_uuid", "role", "side", "wanted", "invalid", "t"), "facts")
    turns = facts.where("wanted").select("file_path", "line_no", "conv_key", "role", "side", "t")
    # the offsets are made of them in two ways
    bounds = kept.keep(reply_bounds(turns.where(~F.col("side"))), "bounds")
    clocks = kept.keep(session_offsets(bounds), "clocks").withColumnRenamed("conv_key", "__c")
    shift = F.when((F.col("role") == "user") & ~F.col("side"), F.round("offset_ms").cast("bigint"))
    turns = turns.join(clocks, F.col("conv_key") == F.col("__c"), "left").withColumn("t_ms", F.col("t") + F.coalesce(shift, F.lit(0)))
    order = kept.keep(merge_times(turns.drop("__c", "t", "offset_ms", "clocks_ok")), "order")
    place = F.struct("said", "line_no")
    ends = order.where(~F.col("side")).groupBy(F.col("conv_key").alias("__e")).agg(F.min_by("role", place).alias("first"), F.max_by("role", place).alias("last"))
    named = facts.where(F.col("leaf_uuid").isNotNull()).select("conv_key", F.col("leaf_uuid").alias("uuid")).distinct()
    lost = (
        named.join(facts.select("conv_key", "uuid"), ["conv_key", "uuid"], "left_anti")
        .groupBy(F.col("conv_key").alias("__lost"))
        .agg(F.count("*").alias("n_lost"))
    )
    sessions = facts.groupBy("conv_key").agg(F.max("invalid").alias("invalid"))
    for other, key in ((ends, "__e"), (lost, "__lost"), (clocks, "__c")):
        sessions = sessions.join(other, F.col("conv_key") == F.col(key), "left")
    reason = (
        F.when(F.col("first").isNull(), "empty")
        .when(F.col("invalid") | F.col("n_lost").isNotNull(), "broken")
        .when((F.col("first") != "user") | (F.col("last") != "assistant"), "unanswered")
        .otherwise("")
    )
    verdicts = sessions.select(
        "conv_key", reason.alias("reason"), F.coalesce("offset_ms", F.lit(0.0)).alias("offset_ms"), F.coalesce("clocks_ok", F.lit(True)).alias("clocks_ok")
    )
    return kept.keep(verdicts, "verdicts"), order


def judge_sessions(lines: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """``conv_key, reason`` per session; '' to keep."""
    return session_verdicts(lines, devices)[0].select("conv_key", "reason")


def rebuild_sessions(lines: DataFrame, devices: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdicts, turns) of transcripts. verdicts: ``conv_key, reason,
    offset_ms, clocks_ok``; turns: ``conv_key, turn_index, role, text, t_ms``
    (corrected) of kept sessions; sidechain lines have role ``subagent``. Equal
    times keep line order."""
    verdicts, order = session_verdicts(lines, devices)
    good = verdicts.where(F.col("reason") == "").select(F.col("conv_key").alias("__c"))
    order = order.join(good, F.col("conv_key") == F.col("__c"), "left_semi")
    order = _numbered(order, [F.col("said"), F.col("line_no")], F.floor(F.col("said") / 3_600_000), "turn_index")
    texts = _once(line_facts(lines), ["text"])
    turns = order.join(texts, ["file_path", "line_no"])
    return verdicts, turns.select(
        "conv_key",
        F.col("turn_index").cast("int").alias("turn_index"),
        F.when(F.col("side"), F.lit("subagent")).otherwise(F.col("role")).alias("role"),
        "text",
        "t_ms",
    )

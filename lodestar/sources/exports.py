"""Chat exports and agent transcripts as rows of turns.

All readers give ``source, session, title, pos, turn_id, role, text, created``
and what belongs to the whole conversation: ``started`` (its own time) and
``project, cwd, branch, forked_from`` where the source has them. Blank turns are
left out. JSON is read with explicit schemas; of an export, the
elements that do not parse are kept apart by ``export_elements`` and skipped by
the readers, each alone.
"""

from __future__ import annotations

import io
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.columns import has_text, running_total, trim_unicode
from lodestar.functions.scalars import epoch_time, first_non_empty, flexible_time, normalize_time, one_line, truncate
from lodestar.sources.files import array_elements, is_zip, names_in, open_in, payload

CHATGPT = (
    "conversation_id string, id string, title string, create_time string, mapping map<string, struct<message: struct<id: string, "
    "author: struct<role: string>, create_time: string, content: struct<content_type: string, parts: array<string>, text: string, "
    "user_profile: string, user_instructions: string>, metadata: map<string, string>>, parent: string, children: array<string>>>"
)
CLAUDE = (
    "uuid string, name string, created_at string, chat_messages array<struct<uuid: string, sender: string, created_at: string, text: string, "
    "content: array<struct<type: string, text: string, thinking: string>>, attachments: array<struct<file_name: string, extracted_content: string>>>>"
)
CLAUDE_PROJECTS = "uuid string, name string, description string, created_at string, docs array<struct<uuid: string, filename: string, content: string, created_at: string>>"
CC_LINE = (
    "type string, uuid string, leafUuid string, sessionId string, timestamp string, cwd string, gitBranch string, isMeta boolean, "
    "isSidechain boolean, summary string, aiTitle string, message struct<role: string, content: string>"
)
CODEX_LINE = "timestamp string, type string, payload struct<id: string, timestamp: string, cwd: string, type: string, message: string>"

#: Characters of raw elements that are handed on together.
BATCH = 1 << 22

_ORDER = T.ArrayType(T.IntegerType())


def _whole(**known: Column) -> list[Column]:
    """The columns of the whole conversation, null where not known."""
    names = ("started", "project", "cwd", "branch", "forked_from")
    filled = {k: F.when(has_text(v), trim_unicode(v)) for k, v in known.items()}
    return [filled.get(n, F.lit(None).cast("string")).alias(n) for n in names]


def _numbered_session(df: DataFrame, *names: str) -> Column:
    """The first non-empty of the columns, else the element's place in its export."""
    place = F.concat(F.lit("conversation-"), F.col("element_no").cast("string")) if "element_no" in df.columns else F.lit("")
    return first_non_empty(*[F.coalesce(F.col(n), F.lit("")) for n in names], place)


def walk_order(ids: list[str], parents: list, children: list) -> list[int]:
    """Depth first from the roots in id order, then from nodes whose parent is
    missing, then from nodes not reached; each node once."""
    at = {x: i for i, x in enumerate(ids)}
    by_id = sorted(range(len(ids)), key=lambda i: ids[i])
    seen, out = set(), []

    def visit(start: int) -> None:
        stack = [start]
        while stack:
            i = stack.pop()
            if i in seen:
                continue
            seen.add(i)
            out.append(i)
            stack.extend(at[c] for c in reversed(children[i] if children[i] is not None else []) if c in at)

    for group in (lambda p: not p, lambda p: p and p not in at, lambda p: True):
        for i in by_id:
            if group(parents[i]):
                visit(i)
    return out


def _order_udf():
    @F.pandas_udf(_ORDER)
    def order(nodes: pd.Series) -> pd.Series:
        return pd.Series(
            [walk_order([x["i"] for x in g], [x["p"] for x in g], [x["c"] for x in g]) if g is not None else [] for g in nodes], dtype=object
        )

    return order


def _part_text(p: Column) -> Column:
    v = F.try_parse_json(p)
    inner = F.when(F.ltrim(p).startswith("{"), F.try_variant_get(v, "$.text", "string")).when(
        F.ltrim(p).startswith('"'), F.try_variant_get(v, "$", "string")
    )
    # parts of an export read with a schema of strings are bare texts
    return trim_unicode(F.coalesce(inner, F.when(~F.ltrim(p).rlike(r'^[{\["]'), p)))


def _moment(value: Column) -> Column:
    """Seconds since 1970, or a time as text."""
    text = value.cast("string")
    seconds = text.try_cast("double")
    return F.when(seconds.isNotNull(), epoch_time(seconds)).otherwise(normalize_time(text))


def chatgpt_turns(convs: DataFrame) -> DataFrame:
    """Turns of chat-export records, in graph order."""
    nodes = F.transform(F.map_entries("mapping"), lambda e: F.struct(e["key"].alias("i"), e["value"]["parent"].alias("p"), e["value"]["children"].alias("c")))
    session = _numbered_session(convs, "conversation_id", "id")
    rows = convs.select(
        session.alias("session"), F.trim(F.coalesce("title", F.lit(""))).alias("title"), _moment(F.col("create_time")).alias("began"),
        F.map_entries("mapping").alias("e"), _order_udf()(nodes).alias("o"),
    )
    rows = rows.select("session", "title", "began", F.posexplode("o").alias("pos", "k"), "e").withColumn("n", F.get("e", F.col("k"))).drop("e")
    m = F.col("n.value.message")
    texts = F.filter(F.transform(F.coalesce(m["content"]["parts"], F.array().cast("array<string>")), _part_text), lambda t: t.rlike(r"(?U)\S"))
    other = F.filter(F.array(*[trim_unicode(m["content"][f]) for f in ("text", "user_profile", "user_instructions")]), lambda t: t.rlike(r"(?U)\S"))
    text = F.array_join(F.when(F.size(texts) > 0, texts).otherwise(other), "\n")
    hidden = F.coalesce(m["metadata"]["is_visually_hidden_from_conversation"] == "true", F.lit(False))
    out = rows.select(
        F.lit("chatgpt").alias("source"), "session", "title", "pos", first_non_empty(F.coalesce(m["id"], F.lit("")), F.col("n.key")).alias("turn_id"),
        F.coalesce(m["author"]["role"], F.lit("unknown")).alias("role"), text.alias("text"), _moment(m["create_time"]).alias("created"), hidden.alias("h"),
        *_whole(started=F.col("began")),
    )
    return out.where(~F.col("h") & has_text(F.col("text"))).drop("h")


def _named(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(path, n) for n in names], "path string, name string")


def export_elements(spark: SparkSession, path: str, schema: str, base: str = "conversations.json") -> DataFrame:
    """``element_no, raw, value, error``: every element of an export's array;
    ``error`` is null where the element is of the schema. ``path`` is a file, or
    a directory or zip archive whose shallowest ``base`` is taken."""

    def batches_of(stream):
        rows, held = [], 0
        for k, (raw, error) in enumerate(array_elements(stream)):
            rows.append((k, raw, error))
            held += len(raw or "")
            if held > BATCH:
                yield pd.DataFrame(rows, columns=["element_no", "raw", "error"])
                rows, held = [], 0
        yield pd.DataFrame(rows, columns=["element_no", "raw", "error"])

    def split(batches):
        for b in batches:
            if "content" in b:
                for content in b["content"]:
                    yield from batches_of(io.BytesIO(content))
                continue
            for p, n in zip(b["path"], b["name"]):
                with open_in(p, n) as f:
                    yield from batches_of(f)

    local = path.removeprefix("file:")
    name = payload(local, base) if os.path.exists(local) else None
    if name is None and is_zip(local):
        raise ValueError(f"{path}: no {base} in this archive")
    files = spark.read.format("binaryFile").load(path).select("content") if name is None else _named(spark, local, [name])
    rows = files.mapInPandas(split, "element_no int, raw string, error string")
    value = F.from_json("raw", f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    rows = rows.withColumn("value", value)
    return rows.withColumn("error", F.coalesce("error", F.when(F.col("value.__bad").isNotNull(), "not of the schema")))


def _good(elements: DataFrame) -> DataFrame:
    return elements.where(F.col("error").isNull()).select("element_no", "value.*").drop("__bad")


def read_chatgpt(spark: SparkSession, path: str) -> DataFrame:
    return chatgpt_turns(_good(export_elements(spark, path, CHATGPT)))


def claude_turns(convs: DataFrame) -> DataFrame:
    """Turns of the other chat export: content blocks (text and thinking), else
    the flat text, then attachments."""
    rows = convs.select(
        _numbered_session(convs, "uuid").alias("session"), F.trim(F.coalesce("name", F.lit(""))).alias("title"),
        normalize_time(F.col("created_at")).alias("began"), F.posexplode("chat_messages").alias("pos", "m"),
    )
    m = F.col("m")
    blocks = F.flatten(F.transform(F.coalesce(m["content"], F.array()), lambda b: F.array(trim_unicode(b["text"]), trim_unicode(b["thinking"]))))
    blocks = F.filter(blocks, lambda t: t.rlike(r"(?U)\S"))
    body = F.when(F.size(blocks) > 0, blocks).otherwise(F.filter(F.array(trim_unicode(m["text"])), lambda t: t.rlike(r"(?U)\S")))
    files = F.transform(
        F.filter(F.coalesce(m["attachments"], F.array()), lambda a: a["extracted_content"].rlike(r"(?U)\S")),
        lambda a: F.concat_ws("\n", a["file_name"], a["extracted_content"]),
    )
    return rows.select(
        F.lit("claude").alias("source"), "session", "title", "pos",
        first_non_empty(F.coalesce(m["uuid"], F.lit("")), F.concat(F.lit("m"), F.col("pos").cast("string"))).alias("turn_id"),
        F.when(m["sender"] == "human", "user").otherwise(F.coalesce(m["sender"], F.lit("unknown"))).alias("role"),
        F.array_join(F.concat(body, files), "\n").alias("text"), normalize_time(m["created_at"]).alias("created"),
        *_whole(started=F.col("began")),
    ).where(has_text(F.col("text")))


def read_claude(spark: SparkSession, path: str) -> DataFrame:
    return claude_turns(_good(export_elements(spark, path, CLAUDE)))


def read_claude_projects(spark: SparkSession, path: str) -> DataFrame:
    """``id, text, name, created, project, session``: a document per description
    and file."""
    p = _good(export_elements(spark, path, CLAUDE_PROJECTS, "projects.json"))
    p = p.withColumn("session", first_non_empty(F.coalesce("uuid", F.lit("")), F.concat(F.lit("project-"), F.col("element_no").cast("string"))))
    head = F.concat(F.lit("claude:project:"), "session")
    start = normalize_time(F.col("created_at"))
    about = p.select(
        head.alias("id"), trim_unicode(F.col("description")).alias("text"), F.lit("description").alias("name"), start.alias("created"),
        F.col("name").alias("project"), "session",
    )
    docs = p.select("session", "name", start.alias("start"), F.posexplode("docs").alias("j", "d")).select(
        F.concat(head, F.lit(":"), first_non_empty(F.coalesce("d.uuid", F.lit("")), F.concat(F.lit("doc"), F.col("j").cast("string")))).alias("id"),
        trim_unicode(F.col("d.content")).alias("text"), F.col("d.filename").alias("name"),
        first_non_empty(F.coalesce(normalize_time(F.col("d.created_at")), F.lit("")), F.coalesce("start", F.lit(""))).alias("created"),
        F.col("name").alias("project"), "session",
    )
    return about.unionByName(docs).where(has_text(F.col("text")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file_path, line_no, value``: every line with its number in its file,
    also of the files of a zip archive (``archive.zip!/entry``); a file is read
    by one task, as its lines are numbered in order."""

    def numbered(p, stream):
        lines, first, held = [], 1, 0
        for line in stream:
            lines.append(line.removesuffix(b"\n").decode("utf-8", "replace"))
            held += len(line)
            if held > BATCH:
                yield pd.DataFrame({"file_path": p, "line_no": range(first, first + len(lines)), "value": lines})
                lines, first, held = [], first + len(lines), 0
        yield pd.DataFrame({"file_path": p, "line_no": range(first, first + len(lines)), "value": lines})

    def split(batches):
        for b in batches:
            if "content" in b:
                for p, content in zip(b["path"], b["content"]):
                    yield from numbered(p, io.BytesIO(content))
                continue
            for p, n in zip(b["path"], b["name"]):
                with open_in(p, n) as f:
                    yield from numbered(f"{p}!/{n}" if is_zip(p) else f"{p}/{n}" if os.path.isdir(p) else p, f)

    local = path.removeprefix("file:")
    if os.path.exists(local):
        files = _named(spark, local, [n for n in names_in(local) if n.lower().endswith(".jsonl")])
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(path).select("path", "content")
    return files.mapInPandas(split, "file_path string, line_no int, value string").where(F.trim("value") != "")


def _positions(lines: DataFrame) -> DataFrame:
    """Adds ``pos``, the number of lines before in the file; a file that holds a
    third of all lines is counted in buckets of lines."""
    rows = lines.withColumn("__bucket", F.floor(F.col("line_no") / 4096))
    rows = running_total(rows, ["file_path"], "__bucket", [F.col("line_no")], F.lit(1), "pos")
    return rows.withColumn("pos", F.col("pos").cast("int")).drop("__bucket")


def block_text(content: Column) -> Column:
    """A JSON string, or the text and thinking blocks of a JSON array."""
    v = F.try_parse_json(content)
    blocks = F.from_json(F.when(F.ltrim(content).startswith("["), content), "array<struct<type:string,text:string,thinking:string>>")
    kept = F.transform(blocks, lambda b: trim_unicode(F.when(b["type"] == "text", b["text"]).when(b["type"] == "thinking", b["thinking"])))
    joined = F.array_join(F.filter(kept, lambda t: t.rlike(r"(?U)\S")), "\n")
    flat = F.when(F.ltrim(content).startswith('"'), F.try_variant_get(v, "$", "string")).when(~F.ltrim(content).rlike(r'^[\["{]'), content)
    return F.coalesce(joined, trim_unicode(flat))


def claude_code_turns(lines: DataFrame) -> DataFrame:
    """Turns of transcript lines (``file_path, line_no, type, uuid, sessionId,
    timestamp, cwd, gitBranch, isMeta, isSidechain, summary, aiTitle, message``).
    The folder of a transcript names its project; session, working folder and
    branch are the last that its lines name."""
    base = F.regexp_replace(F.regexp_extract("file_path", r"([^/\\]*)$", 1), r"(?i)\.jsonl$", "")
    counts = ~F.coalesce(F.col("isMeta"), F.lit(False))
    at = lambda c: F.when(counts & (F.coalesce(c, F.lit("")) != ""), F.col("line_no"))
    heads = lines.groupBy("file_path").agg(
        F.max_by("sessionId", at("sessionId")).alias("sid"), F.max_by("aiTitle", at("aiTitle")).alias("ai"),
        F.min_by("summary", at("summary")).alias("sum"), F.max_by("cwd", at("cwd")).alias("folder"),
        F.max_by("gitBranch", at("gitBranch")).alias("git"), F.min_by("timestamp", at("timestamp")).alias("began"),
    )
    project = F.regexp_extract("file_path", r"([^/\\!]*)[/\\][^/\\]*$", 1)
    text = F.when(F.col("type") == "summary", F.col("summary")).otherwise(block_text(F.col("message.content")))
    role = F.when(F.col("type") == "summary", F.lit("summary")).otherwise(F.coalesce("message.role", "type"))
    role = F.when(F.coalesce("isSidechain", F.lit(False)), F.concat(role, F.lit("/subagent"))).otherwise(role)
    kept = lines.where(
        ~F.coalesce(F.col("isMeta"), F.lit(False)) & (F.coalesce("aiTitle", F.lit("")) == "") & (F.col("message").isNotNull() | (F.col("type") == "summary")) & has_text(text)
    )
    rows = _positions(kept).join(heads, "file_path")
    return rows.select(
        F.lit("claude-code").alias("source"), F.coalesce("sid", base).alias("session"), F.coalesce("ai", "sum", F.lit("")).alias("title"), F.col("pos"),
        first_non_empty(F.coalesce("uuid", F.lit("")), F.concat(F.lit("line"), F.col("line_no").cast("string"))).alias("turn_id"),
        role.alias("role"), text.alias("text"), normalize_time(flexible_time(F.coalesce("timestamp", F.lit("")))).alias("created"),
        *_whole(started=normalize_time(flexible_time(F.col("began"))), project=project, cwd=F.col("folder"), branch=F.col("git")),
    )


def read_claude_code(spark: SparkSession, path: str) -> DataFrame:
    lines = numbered_lines(spark, path).withColumn("j", F.from_json("value", CC_LINE))
    return claude_code_turns(lines.select("file_path", "line_no", "j.*"))


def read_codex(spark: SparkSession, path: str) -> DataFrame:
    """Turns of rollouts: user and agent message events. The first session record
    names the session, its time and working folder (whose last part is the
    project), a later one where it was forked from; the first user turn is the
    title."""
    lines = numbered_lines(spark, path).withColumn("j", F.from_json("value", CODEX_LINE)).select("file_path", "line_no", "j.*")
    p = F.col("payload")
    meta = F.when(F.col("type") == "session_meta", F.col("line_no"))
    said = (F.col("type") == "event_msg") & p["type"].isin("user_message", "agent_message") & has_text(p["message"])
    heads = lines.groupBy("file_path").agg(
        F.min_by(F.struct(p["id"].alias("id"), p["cwd"].alias("cwd"), F.coalesce(p["timestamp"], "timestamp").alias("began")), meta).alias("own"),
        F.sort_array(F.collect_set(F.when(meta.isNotNull(), F.struct("line_no", p["id"].alias("id"))))).alias("metas"),
        F.min_by(p["message"], F.when(said & (p["type"] == "user_message"), F.col("line_no"))).alias("first"),
    )
    base = F.regexp_replace(F.regexp_extract("file_path", r"([^/\\]*)$", 1), r"(?i)\.jsonl$", "")
    return _positions(lines.where(said)).join(heads, "file_path").select(
        F.lit("codex").alias("source"), F.coalesce("own.id", base).alias("session"), F.coalesce(truncate(one_line(F.col("first")), 72), F.lit("")).alias("title"),
        F.col("pos"), F.concat(F.lit("line"), F.col("line_no").cast("string")).alias("turn_id"),
        F.when(p["type"] == "user_message", "user").otherwise("assistant").alias("role"), trim_unicode(p["message"]).alias("text"),
        normalize_time(F.col("timestamp")).alias("created"),
        *_whole(
            started=normalize_time(F.col("own.began")), cwd=F.col("own.cwd"), project=F.regexp_extract("own.cwd", r"([^/\\]+)[/\\]*$", 1),
            forked_from=F.get("metas", F.lit(1))["id"],
        ),
    )

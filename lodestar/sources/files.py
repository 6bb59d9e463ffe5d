"""Plain files and zip archives as documents, and format detection."""

from __future__ import annotations

import codecs
import io
import json
import os
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.scalars import is_binary

LARGEST = 10 * 1024 * 1024
EXTENSIONS = (".md", ".txt")
ENTRY = "path string, name string, size bigint, modified timestamp, content binary"


def entries(spark: SparkSession, path: str) -> DataFrame:
    """``path, name, size, modified, content`` of every file below ``path``;
    entries of a zip archive have ``archive.zip!entry`` as path. Unreadable
    archives and entries are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, m, n, c in zip(b["path"], b["modificationTime"], b["length"], b["content"]):
                p = p.removeprefix("file:")
                if not p.lower().endswith(".zip"):
                    yield pd.DataFrame({"path": [p], "name": [os.path.basename(p)], "size": [n], "modified": [m], "content": [c]})
                    continue
                try:
                    archive = zipfile.ZipFile(io.BytesIO(c))
                except zipfile.BadZipFile:
                    continue
                with archive as z:
                    for i in z.infolist():
                        if i.is_dir() or i.file_size > LARGEST:
                            continue
                        try:
                            data = z.read(i)
                        except (RuntimeError, zipfile.BadZipFile):
                            continue
                        yield pd.DataFrame({"path": [f"{p}!{i.filename}"], "name": [os.path.basename(i.filename)], "size": [len(data)], "modified": [m], "content": [data]})

    return files.mapInPandas(unpack, ENTRY)


def file_documents(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``id, text, attrs``: text files of the given extensions up to 10 MiB
    without a zero byte in their first 8192."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["path"], "text": [c.decode("utf-8", "replace") for c in b["content"]], "name": b["name"], "size": b["size"], "modified": b["modified"]})

    dot = F.regexp_extract("name", r"(\.[^.]*)$", 1)
    rows = entries(spark, path).where(dot.isin(*extensions) & (F.col("size") <= LARGEST) & ~is_binary(F.col("content")))
    rows = rows.mapInPandas(texts, "id string, text string, name string, size bigint, modified timestamp")
    attrs = F.to_json(F.struct(F.lit("file").alias("kind"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"), "name", F.col("id").alias("path"), "size"))
    return rows.select("id", "text", attrs.alias("attrs"))


def array_elements(stream: BinaryIO, chunk: int = 1 << 20) -> Iterator[tuple[str | None, str | None]]:
    """``(raw, error)`` of every element of a JSON array, read piece by piece;
    after a syntax error nothing can be told apart, so it ends the elements
    with one ``(None, error)``."""
    decoder, text, at, ended = codecs.getincrementaldecoder("utf-8-sig")("replace"), "", 0, False

    def more() -> None:
        # an element that does not fit is decoded anew: twice the text each time
        nonlocal text, at, ended
        data = stream.read(max(chunk, len(text) - at))
        ended = not data
        text, at = text[at:] + decoder.decode(data, ended), 0

    def peek() -> str:
        """The next character that is no white space; empty at the end."""
        nonlocal at
        while True:
            while at < len(text) and text[at] in " \t\r\n":
                at += 1
            if at < len(text) or ended:
                return text[at : at + 1]
            more()

    if peek() != "[":
        yield None, "not a JSON array"
        return
    at += 1
    if peek() == "]":
        return
    opened = True
    while opened:
        peek()
        try:
            _, end = json.JSONDecoder().raw_decode(text, at)
            whole = end < len(text) or ended
        except ValueError:
            whole, end = False, -1
        except RecursionError:
            yield None, "nested too deep"
            return
        if not whole and not ended:
            more()
            continue
        if end < 0:
            yield None, "malformed JSON"
            return
        raw, at = text[at:end], end
        yield raw, None
        opened = peek() == ","
        if not opened and peek() != "]":
            yield None, "malformed JSON"
        at += 1


def sniff_export(head: str) -> str:
    """chatgpt or claude, by the first element of a JSON array."""
    text = head.lstrip()
    if not text.startswith("["):
        raise ValueError("not a JSON array")
    try:
        first, _ = json.JSONDecoder().raw_decode(text[1:].lstrip())
    except ValueError:
        raise ValueError("no conversation in the export") from None
    for key, kind in (("mapping", "chatgpt"), ("chat_messages", "claude")):
        if isinstance(first, dict) and key in first:
            return kind
    raise ValueError("unknown export")


def sniff_lines(lines: list[str]) -> str | None:
    """claude-code or codex, by the first five lines of a transcript."""
    for line in lines[:5]:
        try:
            x = json.loads(line)
        except ValueError:
            continue
        if not isinstance(x, dict):
            continue
        if x.get("sessionId") or (x.get("uuid") and x.get("type")):
            return "claude-code"
        if x.get("payload") and x.get("type") in ("session_meta", "response_item", "event_msg", "turn_context"):
            return "codex"
    return None


def shallowest(names: list[str], base: str) -> str | None:
    """The path with this base name (any case) that lies least deep."""
    found = [n for n in names if os.path.basename(n).lower() == base.lower()]
    return min(found, key=lambda n: (n.count("/"), names.index(n)), default=None)


def is_zip(path: str) -> bool:
    return path.lower().endswith(".zip") and not os.path.isdir(path)


def names_in(path: str) -> list[str]:
    """Relative paths of all files of a directory or archive; the base name of
    a file."""
    if os.path.isdir(path):
        return sorted(os.path.relpath(os.path.join(r, f), path) for r, _, fs in os.walk(path) for f in fs)
    if is_zip(path):
        with zipfile.ZipFile(path) as z:
            return [i.filename for i in z.infolist() if not i.is_dir()]
    return [os.path.basename(path)]


@contextmanager
def open_in(path: str, name: str) -> Iterator[BinaryIO]:
    """One of ``names_in(path)`` as a stream of bytes, of any size."""
    if is_zip(path):
        with zipfile.ZipFile(path) as z, z.open(name) as f:
            yield f
    else:
        with open(os.path.join(path, name) if os.path.isdir(path) else path, "rb") as f:
            yield f


def payload(path: str, base: str) -> str | None:
    """The name in ``path`` of the export with this base name, or of its only
    file where that is JSON."""
    names = names_in(path)
    only = names[0] if len(names) == 1 and (names[0].endswith(".json") or not (os.path.isdir(path) or is_zip(path))) else None
    return shallowest(names, base) or only


def detect(path: str) -> str:
    """The format of a directory, archive or file: chatgpt, claude,
    claude-code, codex or files."""
    names = names_in(path)
    export = shallowest(names, "conversations.json")
    if export is None and len(names) == 1 and names[0].endswith(".json"):
        export = names[0]
    if export is not None:
        with open_in(path, export) as f:
            # the first element whole, however large
            raw, error = next(array_elements(f), (None, "no conversation in the export"))
        if error:
            raise ValueError(error)
        return sniff_export(f"[{raw}]")
    lines = next((n for n in names if n.lower().endswith(".jsonl")), None)
    if lines is None:
        return "files"
    with open_in(path, lines) as f:
        head = [f.readline().decode("utf-8", "replace") for _ in range(5)]
    return sniff_lines(head) or "files"

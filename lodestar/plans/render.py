"""Answers as text for a terminal. All of it works on the few rows of an answer."""

from __future__ import annotations

import os
import shutil
import sys
import textwrap

NARROWEST, WIDEST = 32, 84
#: How sources are called.
SOURCES = {"chatgpt": "ChatGPT", "claude": "Claude", "claude-code": "Claude Code", "codex": "Codex"}


def plural(n: int, one: str) -> str:
    return f"{n} {one}" if n == 1 else f"{n} {one}s"


def wrap(text: str, width: int, first: str = "", rest: str = "") -> list[str]:
    """Words in lines of at most ``width`` characters, prefixes included; a word
    that is longer stands on a line of its own."""
    lines = textwrap.wrap(text, max(width, 1), initial_indent=first, subsequent_indent=rest, break_long_words=False, break_on_hyphens=False)
    return lines or [first.rstrip()]


def text_width(columns: int | None = None) -> int:
    columns = columns if columns is not None else shutil.get_terminal_size((80, 24)).columns
    return min(max(columns, NARROWEST), WIDEST)


def attr_text(attrs: dict, *keys: str) -> str:
    """The first of the attributes that is a non-empty text."""
    return next((v for k in keys if isinstance(v := attrs.get(k), str) and v), "")


def attr_date(attrs: dict) -> str:
    """The day a document was created, else modified."""
    return attr_text(attrs, "created", "modified")[:10]


def source_label(attrs: dict) -> str:
    source = attr_text(attrs, "source")
    return SOURCES.get(source, source) or ("file" if attr_text(attrs, "path", "name") else "")


def display_id(ident: str, attrs: dict) -> str:
    """A file's name, a conversation's title, else the id."""
    return attr_text(attrs, "name", "title") or ident


def citation(ident: str, attrs: dict) -> str:
    """Where a result comes from: source, name, role and day."""
    return " · ".join(x for x in (source_label(attrs), display_id(ident, attrs), attr_text(attrs, "role"), attr_date(attrs)) if x)


def rankers(row: dict) -> str:
    """Which rankings found a result, and where it stood in them."""
    found = [f"{name} {row[f'{name}_rank']}" for name in ("keyword", "semantic") if row.get(f"{name}_rank")]
    return ", ".join(found)


class Style:
    """Terminal colours, none where the output is no terminal."""

    def __init__(self, on: bool | None = None) -> None:
        self.on = on if on is not None else sys.stdout.isatty() and not os.environ.get("NO_COLOR")

    def bold(self, text: str) -> str:
        return f"\x1b[1m{text}\x1b[0m" if self.on else text

    def faint(self, text: str) -> str:
        return f"\x1b[2m{text}\x1b[0m" if self.on else text


def render_results(rows: list[dict], width: int | None = None, style: Style | None = None) -> str:
    """Numbered results: citation, text, and how they were found."""
    style, width = style or Style(), text_width(width)
    if not rows:
        return "no matches"
    out, margin = [], len(str(len(rows))) + 2
    for n, row in enumerate(rows, 1):
        attrs = row.get("attributes") or {}
        out.append(style.bold(f"{n}.".ljust(margin) + citation(row["id"], attrs)))
        out += wrap(" ".join((row.get("text") or "").split()), width, " " * margin, " " * margin)
        out.append(style.faint(" " * margin + f"{rankers(row)} (score {row['score']:.4f})"))
        out.append("")
    return "\n".join(out[:-1])


def render_rows(rows: list[dict], total: int, one: str, offset: int = 0) -> str:
    """A page of groups or documents, a line each, and a tally."""
    lines = []
    for r in rows:
        count = plural(r["documents"], "document") if "documents" in r else plural(r.get("chunks", 0), "chunk")
        lines.append("  ".join(str(x) for x in ((r.get("created") or "")[:10].ljust(10), r.get("key") or r.get("id"), count)))
    if len(rows) < total:
        lines.append(f"{offset + 1}-{offset + len(rows)} of {plural(total, one)}" if rows else f"none of {plural(total, one)}")
    else:
        lines.append(plural(total, one))
    return "\n".join(lines)

"""Canonical spellings of document sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_source(c: Column) -> Column:
    """Lower case, trimmed, words joined by '-'; 'unknown' where null or blank."""
    s = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")), r"(?U)[_\s]+", "-")
    s = F.when(s == "chat-gpt", "chatgpt").when(s == "claudecode", "claude-code").when(s == "file", "files").otherwise(s)
    return F.when(s != "", s).otherwise(F.lit("unknown"))

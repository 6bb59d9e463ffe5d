"""Splitting oversized items at natural boundaries.

A separator hierarchy: sections, paragraphs, lines, sentences, words,
characters. Starting at a position, the piece takes as many whole units of the
coarsest kind as fit and fill at least half of the limit; failing that it
descends to the next kind. The next piece starts up to ``overlap`` bytes
before the cut, at the beginning of a word where there is one. Sizes are UTF-8
bytes; each piece is trimmed.

Defined results:
* null and blank texts give no pieces; a text within the limit gives itself;
* a null or non-positive size is 1000, a null or negative overlap 0, an
  overlap of the size or more a tenth of the size;
* a character larger than the limit is a piece of its own;
* texts are never cut short, however long; repeated rows give repeated pieces;
* input columns named like an output column are renamed ``*_in``.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.columns import has_text, once, shield, trim_unicode

#: Cut positions are the ends of these matches, coarsest first.
LEVELS = (
    rb"\n(?=#{1,6} )|\n[ \t]*\n[ \t]*\n\s*|\f|\n(?=(?:={3,}|-{3,})\n)",
    rb"\r?\n[ \t]*\r?\n\s*",
    rb"\r?\n",
    rb"[.!?][\"')\]]*\s+|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)\s*",
    rb"\s+|\xe3\x80\x80",
)
OUT = ("ord", "piece", "piece_bytes", "n_pieces", "oversized")


def _aligned(data: bytes, at: int) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def split_text(text: str, size: int, overlap: int) -> list[str]:
    """The pieces of one text."""
    text = text.strip()
    if not text:
        return []
    size = size if size and size > 0 else 1000
    overlap = max(overlap or 0, 0)
    overlap = size // 10 if overlap >= size else overlap
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= size:
        return [text]
    cuts = [[m.end() for m in re.finditer(p, data)] for p in LEVELS]
    pieces, start, done = [], 0, 0
    while True:
        limit = start + size
        if limit >= len(data):
            pieces.append(data[start:])
            break
        reach = limit  # white space that is trimmed off may reach over the limit
        while reach < len(data) and data[reach] in b" \t\r\n\f\v":
            reach += 1
        best = 0
        for floor in (max(done, start + size // 2), done):
            for at in cuts:
                i = bisect_right(at, reach) - 1
                if i >= 0 and at[i] > floor:
                    best = at[i]
                    break
            if best:
                break
        if not best:
            best = _aligned(data, limit)
        if best <= done and start < done:  # the overlap left no room to move on
            start = done
            continue
        if best <= done:  # one character larger than the limit
            best = done + 1
            while best < len(data) and data[best] & 0xC0 == 0x80:
                best += 1
        pieces.append(data[start:best])
        done = best
        if done >= len(data):
            break
        start = done
        if overlap:
            back = max(done - overlap, 0)
            words = cuts[-1]
            i = bisect_right(words, back - 1)
            ahead = words[i] if i < len(words) else done
            start = ahead if ahead < done else _aligned(data, back)
            if start < back:  # alignment moved back: step over that character
                start = done if back >= done else back
                while start < done and data[start] & 0xC0 == 0x80:
                    start += 1
    out = [p.decode("utf-8", "surrogatepass").strip() for p in pieces]
    return [p for p in out if p]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split(text: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series(
        [None if t is None else split_text(t, int(s), int(o)) for t, s, o in zip(text, size, overlap)],
        dtype=object,
    )


def split_oversized(df: DataFrame, text: str, size: str, overlap: str) -> DataFrame:
    """One row per piece: the input columns and ``ord, piece, piece_bytes,
    n_pieces, oversized``. Texts within their limit never leave the JVM."""
    names = {c: f"{c}_in" if c in OUT else c for c in (text, size, overlap)}
    df = shield(df, OUT)
    text, size, overlap = (names[c] for c in (text, size, overlap))
    limit = F.when(F.col(size) > 0, F.col(size)).otherwise(F.lit(1000))
    over = F.greatest(F.coalesce(F.col(overlap), F.lit(0)), F.lit(0))
    trimmed = trim_unicode(F.col(text))
    big = F.octet_length(trimmed) > limit
    df = df.withColumn("__big", F.coalesce(big, F.lit(False)))
    pieces = F.when(F.col("__big"), _split(F.when(F.col("__big"), F.col(text)), limit, over)).otherwise(
        F.when(has_text(F.col(text)), F.array(trimmed))
    )
    kept = [F.col(f"`{c}`") for c in df.columns if c != "__big"]
    df = df.select(*kept, F.col("__big").alias("oversized"), pieces.alias("__made"))
    df = once(df, {"__pieces": F.col("__made")}).drop("__made")
    df = df.withColumn("n_pieces", F.coalesce(F.size("__pieces"), F.lit(0)))
    return df.select(
        *kept, F.posexplode("__pieces").alias("ord", "piece"), "n_pieces", "oversized"
    ).withColumn("piece_bytes", F.octet_length("piece"))

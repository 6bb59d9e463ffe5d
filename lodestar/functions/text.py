"""Chunking, tokenising and query terms."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Closed-class words that a query does not search for.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from has have he her his i in is it its me my not of on or she that the they this to was we were with you your".split()
)
SEPARATORS = (b"\n\n", b". ", b"\n", b" ")


def _last(marks: list[int], at: int) -> int:
    """The greatest mark up to ``at``; -1 if there is none."""
    i = bisect_right(marks, at)
    return marks[i - 1] if i else -1


def window_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Overlapping windows of at most ``size`` bytes. A window ends after the
    last separator in its last quarter (kinds in order of preference), else at
    a character boundary; the next starts ``overlap`` bytes before its end."""
    data = text.strip().encode("utf-8", "replace")
    size = size if size > 0 else 1000
    overlap = overlap if 0 <= overlap < size else 100
    if len(data) <= size:
        return [data.decode()] if data else []
    # every place where a window may end: after a separator, or between characters
    ends = [[m.start() + len(s) for m in re.finditer(b"(?=" + re.escape(s) + b")", data)] for s in SEPARATORS]
    chars = [*(m.start() for m in re.finditer(rb"[^\x80-\xbf]", data)), len(data)]
    spans, begin, end = [], 0, 0
    while end < len(data):
        limit = begin + size
        if limit >= len(data):
            end = len(data)
        else:
            near = (_last(e, limit) for e in ends)
            after = [e for e, s in zip(near, SEPARATORS) if e - len(s) > limit - size // 4]
            # a character larger than the window goes whole
            end = after[0] if after else max(_last(chars, limit), chars[bisect_right(chars, begin)])
        spans.append((begin, end))
        back = _last(chars, end - overlap)
        begin = back if back > begin else end
    pieces = (data[a:b].decode().strip() for a, b in spans)
    return [p for p in pieces if p]


@F.pandas_udf(T.ArrayType(T.StringType()))
def chunk(text: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    return pd.Series([window_chunks(t, int(s), int(o)) if t else [] for t, s, o in zip(text, size, overlap)], dtype=object)


def query_terms(text: str) -> list[str]:
    """Searchable terms of a query: lower case, at least two characters, no
    stop words; an underscore stays inside a term."""
    return [t for t in re.findall(r"\w+", text.lower()) if len(t) > 1 and t not in STOP_WORDS]


def fold_char(c: str) -> str:
    """Lower case; one accent of a Latin letter is taken off."""
    c = c.lower() if len(c.lower()) == 1 else c.lower()[0]
    d = unicodedata.decomposition(c).split()
    if len(d) == 2 and not d[0].startswith("<"):
        base = chr(int(d[0], 16))
        if base.isascii() and base.isalpha():
            return base
    return c


_TOKEN = re.compile(r"[^\W_]+")


def _measure(s: str) -> int:
    """Number of vowel-consonant sequences."""
    flags = "".join("c" if _consonant(s, i) else "v" for i in range(len(s)))
    return len(re.findall("v+c+", flags))


def _consonant(s: str, i: int) -> bool:
    if s[i] in "aeiou":
        return False
    return not (s[i] == "y" and i > 0 and _consonant(s, i - 1))


def _vowel(s: str) -> bool:
    return any(not _consonant(s, i) for i in range(len(s)))


def _cvc(s: str) -> bool:
    n = len(s)
    return n >= 3 and _consonant(s, n - 1) and not _consonant(s, n - 2) and _consonant(s, n - 3) and s[-1] not in "wxy"


#: The published suffix rules of the Porter stemmer, steps 2 to 4.
STEP2 = (
    "ational:ate tional:tion enci:ence anci:ance izer:ize logi:log bli:ble alli:al entli:ent eli:e ousli:ous ization:ize "
    "ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
)
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _rules(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(r.split(":")) for r in text.split()), key=lambda r: -len(r[0]))


_STEP2, _STEP3, _STEP4 = _rules(STEP2), _rules(STEP3), sorted(STEP4.split(), key=len, reverse=True)


def stem(w: str) -> str:
    """The Porter stem of an ASCII word of three to twenty letters."""
    if not 3 <= len(w) <= 20 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(x)] for x in ("ed", "ing") if w.endswith(x) and _vowel(w[: -len(x)])), None)
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        hit = next((r for r in rules if w.endswith(r[0])), None)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    suffix = next((s for s in _STEP4 if w.endswith(s)), None)
    if suffix:
        base = w[: -len(suffix)]
        if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
            w = base
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


def index_tokens(text: str, memo: dict[str, str] | None = None) -> list[str]:
    """Tokens as the index keeps them: folded, then stemmed."""
    folded = "".join(fold_char(c) if c > "@" else c for c in text) if not text.isascii() else text.lower()
    memo = {} if memo is None else memo
    out = []
    for t in _TOKEN.findall(folded):
        s = memo.get(t)
        if s is None:
            s = memo[t] = stem(t)
        out.append(s)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def porter_tokens(text: pd.Series) -> pd.Series:
    memo: dict[str, str] = {}
    return pd.Series([index_tokens(t, memo) if t else [] for t in text], dtype=object)


def plain_tokens(text: Column) -> Column:
    """Unstemmed tokens, in the JVM."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))

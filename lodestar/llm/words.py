"""Words and word shingles of texts (runs of letters and digits, lower case)."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_spans(text: str) -> list[tuple[str, int, int]]:
    """Words with their place in the original text, also where lowering a
    character makes it longer."""
    low = text.lower()
    if len(low) == len(text):
        return [(m[0], m.start(), m.end()) for m in WORD.finditer(low)]
    low, back = [], []
    for i, c in enumerate(text):
        x = c.lower()
        low.append(x)
        back += [i] * len(x)
    back.append(len(text))
    return [(m[0], back[m.start()], back[m.end() - 1] + 1) for m in WORD.finditer("".join(low))]


def shingle_sets(texts: list, n: int, seen: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, 64-bit hashes) of the distinct ``n``-word shingles of every
    text, sorted by row and hash. ``seen`` keeps word hashes between batches."""
    if len(seen) > 500_000:
        seen.clear()
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        ws = words(t)
        counts[i] = len(ws)
        for w in ws:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh64_intdigest(w)
            hashes.append(h)
    w = np.array(hashes, np.uint64)
    row = np.repeat(np.arange(len(texts)), counts)
    m = max(len(w) - n + 1, 0)
    whole = row[:m] == row[n - 1 : n - 1 + m]  # the shingle stays within its text
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for k in range(n):
            out = (out ^ w[k : k + m]) * _P[k % 3] + np.uint64(k + 1)
            out ^= out >> np.uint64(29)
    row, out = row[:m][whole], out[whole]
    order = np.lexsort((out, row))
    row, out = row[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (row[1:] != row[:-1]) | (out[1:] != out[:-1])
    return row[new], out[new]

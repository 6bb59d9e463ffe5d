"""Evaluation passages inside training documents.

One Aho-Corasick automaton over the word sequences of the held-out items: every
window of ``min_words`` words of an item's text, and every whole answer of at
least ``min_answer_words`` words. Each document is scanned once, as words; what
is found is mapped back to character offsets of the original text. The scan is
a map over the documents: nothing of them is shuffled or collected.

Held-out items are few by nature. Their size is checked against
``LARGEST_ITEMS`` (more is an error); over ``max_item_words`` words they are
scanned in several automata of at most that many words each.

Defined results:
* null and blank documents, and items under ``min_words`` words, match nothing;
* a document row and item row match once per kind, with the longest run and
  its first place; repeated rows are repeated results;
* a null item id or document id is kept as null; empty tables give empty ones;
* other columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.words import word_spans, words

#: Bytes of held-out items that the driver holds.
LARGEST_ITEMS = 1 << 30
SCHEMA = "doc string, item bigint, kind string, n_words int, start int, stop int"


def patterns(items: list[tuple], min_words: int, min_answer_words: int) -> tuple[dict[str, int], dict[tuple, list]]:
    """(word ids, word-id windows -> [(item, kind)])."""
    ids: dict[str, int] = {}
    wins: dict[tuple, list] = {}
    for item, text, answer in items:
        for kind, ws, size in (("text", words(text), min_words), ("answer", words(answer), 0)):
            size = size or len(ws)
            if len(ws) < (min_words if kind == "text" else max(min_answer_words, 1)):
                continue
            nums = [ids.setdefault(w, len(ids) + 1) for w in ws]
            for k in range(len(nums) - size + 1):
                got = wins.setdefault(tuple(nums[k : k + size]), [])
                if (item, kind) not in got:
                    got.append((item, kind))
    return ids, wins


def automaton(wins: dict[tuple, list]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for seq, value in wins.items():
        a.add_word(seq, (len(seq), value))
    if len(a):
        a.make_automaton()
    return a


def scan(text: str | None, ids: dict[str, int], a: ahocorasick.Automaton) -> list[tuple]:
    """(item, kind, words in the longest run, start, stop) per item and kind."""
    ws = words(text)
    if not ws or not len(a):
        return []
    runs: dict[tuple, list] = {}
    for end, (size, value) in a.iter(tuple(ids.get(w, 0) for w in ws)):
        begin = end - size + 1
        for key in value:
            spans = runs.setdefault(key, [])
            if spans and begin <= spans[-1][1] + 1:
                spans[-1][1] = end
            else:
                spans.append([begin, end])
    if not runs:
        return []
    at = word_spans(text)
    out = []
    for (item, kind), spans in runs.items():
        b, e = max(spans, key=lambda s: (s[1] - s[0], -s[0]))
        out.append((item, kind, e - b + 1, at[b][1], at[e][2]))
    return out


def _blocks(items: list[tuple], most: int) -> list[list[tuple]]:
    out, size = [[]], 0
    for it in items:
        n = len(words(it[1])) + len(words(it[2]))
        if out[-1] and size + n > most:
            out.append([])
            size = 0
        out[-1].append(it)
        size += n
    return out


def find_leaks(
    docs: DataFrame,
    doc_id: str,
    text: str,
    items: DataFrame,
    item_id: str,
    item_text: str,
    answer: str | None = None,
    min_words: int = 10,
    min_answer_words: int = 3,
    max_item_words: int = 2_000_000,
) -> DataFrame:
    """``doc_id, item_id, kind ('text' or 'answer'), n_words, start, stop``;
    start and stop are character offsets in the document's own text."""
    rows = items.select(
        F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("a")
    )
    size = F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + F.coalesce(F.octet_length("a"), F.lit(0)))
    if (rows.agg(size.alias("s")).first()["s"] or 0) > LARGEST_ITEMS:
        raise ValueError(f"held-out items of over {LARGEST_ITEMS} bytes: split them and scan once for each part")
    rows = rows.collect()  # bounded by the check above, scanned in blocks
    kind = docs.schema[doc_id].dataType
    sc = docs.sparkSession.sparkContext
    found = []
    for block in _blocks([tuple(r) for r in rows], max_item_words):
        shared = sc.broadcast(patterns(block, min_words, min_answer_words))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, wins = shared.value
            a = automaton(wins)
            for b in batches:
                got = [(d, *x) for d, t in zip(b["doc"], b["text"]) for x in scan(t, ids, a)]
                out = pd.DataFrame(got, columns=["doc", "item", "kind", "n_words", "start", "stop"])
                out["item"] = out["item"].astype("Int64")
                yield out

        found.append(
            docs.select(F.col(doc_id).cast("string").alias("doc"), F.col(text).alias("text")).mapInPandas(run, SCHEMA)
        )
    out = reduce(DataFrame.unionByName, found)
    return out.select(
        F.col("doc").cast(kind).alias(doc_id), F.col("item").alias(item_id if item_id != doc_id else f"{item_id}_item"), "kind", "n_words", "start", "stop"
    )

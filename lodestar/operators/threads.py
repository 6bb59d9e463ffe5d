"""Conversations as documents, transcripts and cards.

Turns come as rows ``source, session, pos, turn_id, role, text, created``;
what belongs to a conversation is gathered per conversation only for its own
document, which holds that text anyway.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.columns import before, has_text, once, running_total, trim_unicode
from lodestar.functions.scalars import normalize_time, slug, yaml_string
from lodestar.functions.summarize import Summarizer, summary_of


#: Positions of a bucket in which turns are counted.
POSITIONS = 4096
#: What the readers know of a whole conversation besides its title.
WHOLE = ("started", "project", "cwd", "branch", "forked_from")


def _known(df: DataFrame, name: str) -> Column:
    """A text column, null where the frame lacks it or it is empty."""
    return F.when(F.col(name) != "", F.col(name)) if name in df.columns else F.lit(None).cast("string")


def turn_documents(turns: DataFrame) -> DataFrame:
    """``id, text, attrs``: a document per turn; an id that repeats within its
    conversation gets ``#<position>``. Attributes that are not known are left
    out; a turn without time has its conversation's."""
    base = F.concat_ws(":", "source", "session", "turn_id")
    w = Window.partitionBy("source", "session", "turn_id").orderBy("pos")
    rows = turns.withColumn("__again", F.row_number().over(w) > 1)
    ident = F.when(F.col("__again"), F.concat(base, F.lit("#"), F.col("pos").cast("string"))).otherwise(base)
    created = normalize_time(F.col("created"))
    known = {n: _known(turns, n) for n in (*WHOLE, "title")}
    known |= {
        "created": F.coalesce(F.when(created != "", created), known.pop("started")),
        "index": F.col("pos"), "kind": F.lit("message"), "role": F.col("role"), "session": F.col("session"), "source": F.col("source"),
    }
    attrs = F.to_json(F.struct(*[known[k].alias(k) for k in sorted(known)]))
    return rows.select(ident.alias("id"), "text", attrs.alias("attrs"))


def conversation_documents(turns: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """``id, text, messages, attrs``: a document per conversation, its turns
    under role headings below its title (``titles``: source, session, title; else
    the turns' own)."""
    part = F.concat(F.lit("## "), F.coalesce("role", F.lit("unknown")), F.lit("\n\n"), F.col("text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("p")))), lambda x: x["p"]), "\n\n")
    own = [F.max(_known(turns, n)).alias(n) for n in (*WHOLE, *(["title"] if titles is None else []))]
    rows = turns.where(F.col("text").isNotNull())
    out = rows.groupBy("source", "session").agg(body.alias("body"), F.count("*").alias("messages"), *own)
    if titles is not None:
        out = out.join(titles.select("source", "session", "title"), ["source", "session"], "left")
    title = F.when(has_text(F.col("title")), F.col("title"))
    known = {n: F.col(n) for n in (*WHOLE, "messages", "session", "source")} | {"title": title, "kind": F.lit("conversation")}
    known["created"] = known.pop("started")
    attrs = F.to_json(F.struct(*[known[k].alias(k) for k in sorted(known)]))
    head = F.coalesce(F.concat(F.lit("# "), title, F.lit("\n\n")), F.lit(""))
    return out.select(
        F.concat_ws(":", "source", "session").alias("id"), trim_unicode(F.concat(head, "body")).alias("text"), "messages", attrs.alias("attrs")
    )


def merged_runs(turns: DataFrame) -> DataFrame:
    """``source, session, run, role, text``: consecutive turns of one role
    joined by a blank line; blank turns are left out.

    Turns meet their predecessor and are counted in buckets of positions, so a session that holds a third of all rows spreads over many tasks."""
    keys = ["source", "session"]
    rows = turns.where(has_text(F.col("text"))).select(*keys, "pos", "role", trim_unicode(F.col("text")).alias("t"))
    rows = rows.withColumn("b", F.floor(F.col("pos") / POSITIONS))
    rows = before(rows, keys, "b", [F.col("pos")], ["role"], "last")
    again = F.col("last").isNotNull() & F.col("last.role").eqNullSafe(F.col("role"))
    rows = rows.withColumn("new", (~again).cast("int")).drop("last")
    rows = running_total(rows, keys, "b", [F.col("pos")], F.col("new"), "run").withColumn("run", (F.col("run") + F.col("new")).cast("bigint"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "\n\n")
    return rows.groupBy(*keys, "run").agg(F.min("role").alias("role"), text.alias("text"))


def first_user_turn(turns: DataFrame) -> DataFrame:
    said = turns.where(F.lower("role").isin("user", "human") & has_text(F.col("text")))
    return said.groupBy("source", "session").agg(F.min_by(trim_unicode(F.col("text")), "pos").alias("first_user"))


def earliest_turn(turns: DataFrame) -> DataFrame:
    at = F.try_to_timestamp(normalize_time(F.col("created")))
    return turns.groupBy("source", "session").agg(F.min(at).alias("earliest"))


def card_stem(created: Column, source: Column, title: Column, ident: Column) -> Column:
    """``YYYY-MM-DD-HHMMSS-source-slug`` from a timestamp (now where null)."""
    return F.concat_ws("-", card_prefix(created, source), F.coalesce(F.nullif(slug(title, 60), F.lit("")), slug(ident, 24)))


def card_prefix(created: Column, source: Column) -> Column:
    """What the cards of one conversation share, whatever its title."""
    return F.concat_ws("-", F.date_format(F.coalesce(created, F.current_timestamp()), "yyyy-MM-dd-HHmmss"), source)


def cards(turns: DataFrame, titles: DataFrame | None = None, service: Summarizer | None = None) -> DataFrame:
    """``path, prefix, markdown, failed``: a card per conversation with front
    matter, title, a summary and a pointer to its document. The summary is the
    service's; without one, or where it fails, the first words of the first user
    turn. A card is dated by its conversation, else by its earliest turn."""
    keys = ["source", "session"]
    whole = conversation_documents(turns, titles).select("id", F.col("text").alias("body"), "attrs", "messages")
    base = turns.select(*keys).distinct().withColumn("id", F.concat_ws(":", *keys)).join(whole, "id")
    base = base.join(first_user_turn(turns), keys, "left").join(earliest_turn(turns), keys, "left")
    known = {n: F.get_json_object("attrs", f"$.{n}") for n in ("title", "created", "project", "cwd", "branch")}
    base = base.withColumns({f"k_{n}": c for n, c in known.items()})
    began = F.coalesce(F.try_to_timestamp(F.col("k_created")), "earliest")

    @F.pandas_udf("summary string, failed boolean")
    def summary(title: pd.Series, body: pd.Series, first: pd.Series) -> pd.DataFrame:
        got = [summary_of(service, t or "", b or "", f or "") for t, b, f in zip(title, body, first)]
        return pd.DataFrame(got, columns=["summary", "failed"])

    title = F.coalesce("k_title", "session")
    base = once(base, {"s": summary(title, F.col("body"), F.col("first_user"))})
    line = lambda k, v: F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\n")), F.lit(""))
    text = F.concat(
        F.lit("---\n"), line("title", yaml_string(title)), line("source", F.col("source")), line("session", yaml_string(F.col("session"))),
        line("created", F.date_format(began, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        *[line(n, yaml_string(F.col(f"k_{n}"))) for n in ("project", "cwd", "branch")],
        line("messages", F.col("messages").cast("string")), F.lit("---\n\n# "), title, F.lit("\n\n"), F.col("s.summary"),
        F.lit("\n\nDocument: "), F.col("id"), F.lit("\n"),
    )
    stem = card_stem(began, F.col("source"), F.col("k_title"), F.col("session"))
    prefix = card_prefix(began, F.col("source"))
    return base.select(F.concat(stem, F.lit(".md")).alias("path"), F.concat(prefix, F.lit("-")).alias("prefix"), text.alias("markdown"), "s.failed")


def write_cards(rows: DataFrame, folder: str) -> dict[str, int]:
    """Writes every card to a file in a folder that all machines share, where
    the conversation's card is renamed with its title: cards of the same moment,
    source and session under another name are removed. Cards are written where
    they are made; only two sums come back."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        there: dict[str, list[str]] = {}  # by date and time, which begin a name
        for old in os.listdir(folder):
            if old.endswith(".md") and not old.startswith("."):
                there.setdefault(old[:17], []).append(old)
        for b in batches:
            for path, prefix, text in zip(b["path"], b["prefix"], b["markdown"]):
                session = next((x for x in text.split("\n") if x.startswith("session: ")), "")
                for old in there.get(path[:17], []):
                    if old.startswith(prefix) and old != path and os.path.exists(os.path.join(folder, old)):
                        with open(os.path.join(folder, old), encoding="utf-8") as f:
                            same = session in f.read().split("\n---\n", 1)[0].split("\n")
                        if same:
                            os.remove(os.path.join(folder, old))
                aside = os.path.join(folder, f".{path}.tmp")
                with open(aside, "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(aside, os.path.join(folder, path))
            yield pd.DataFrame({"written": [len(b)], "failed": [int(b["failed"].sum())]})

    done = rows.mapInPandas(write, "written bigint, failed bigint").agg(F.sum("written").alias("w"), F.sum("failed").alias("f")).first()
    return {"written": done["w"] or 0, "failed": done["f"] or 0}

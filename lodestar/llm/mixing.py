"""Mixing sources to target weights: whole copies and Pareto order sampling.

For each mix, a source must give ``target_share`` of the total size. Every
document of it is taken as often as certain (the whole part of needed size over
its source's size, at most ``max_repeats``); the rest is drawn by Pareto order
sampling: documents are ranked by the odds of a random number (a hash of mix,
document and seed) over the odds of their inclusion, which grows with the
square root of their size, and the first are taken until the size still needed
is reached. Ranks are cut by running totals over value buckets, so a source
that holds a third of all rows spreads over many tasks, and nothing of the
documents reaches the driver.

The total defaults to the largest that every source with documents can reach
within its repeats. Shares are reported against that total and against what
was reached.

Defined results:
* null texts have no tokens; documents without tokens are never drawn;
* null or oddly spelled sources are cleaned first ('unknown' for null);
* a source without documents reaches share 0, the others keep their size;
* ``max_repeats`` null or below 1 means 0 copies; a share null or below 0 is 0;
* repeated rows of one id are separate documents with equal random numbers;
* empty tables give empty results; other columns are not carried.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.columns import bucket_of, running_total
from lodestar.llm.sources import clean_source

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's public pre-tokenisation pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: A vocabulary file is at most so large; its bytes are broadcast.
LARGEST_VOCABULARY = 64 << 20
#: Characters of a text that are encoded together.
PIECE = 1 << 20
#: A place where no token of the pattern reaches over: before a line end that
#: follows something else than white space.
_SEAM = re.compile(r"(?<=\S)(?=\n)")


def encoding(vocabulary: str | bytes, pattern: str = PATTERN):
    """The encoding of a vocabulary file, by its path or its bytes."""
    import tiktoken

    if isinstance(vocabulary, str):
        with open(vocabulary, "rb") as f:
            vocabulary = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """A long text in pieces that give the same tokens as the whole; a stretch
    without a seam stays in one piece."""
    start = 0
    while len(text) - start > most:
        seam = _SEAM.search(text, start + most)
        if not seam:
            break
        yield text[start : seam.start()]
        start = seam.start()
    yield text[start:]


def count_tokens(df: DataFrame, ident: str, text: str, source: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id, src, tokens``. ``vocabulary`` is read on the driver only."""
    kind = df.schema[ident].dataType.simpleString()
    if os.path.getsize(vocabulary) > LARGEST_VOCABULARY:
        raise ValueError(f"{vocabulary} is no vocabulary: over {LARGEST_VOCABULARY} bytes")
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(shared.value)
        for b in batches:
            sizes = [sum(len(enc.encode_ordinary(p)) for p in pieces(t)) if t else 0 for t in b["t"]]
            yield pd.DataFrame({"id": b["id"], "src": b["src"], "tokens": sizes})

    rows = df.select(F.col(ident).alias("id"), clean_source(F.col(source)).alias("src"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"id {kind}, src string, tokens bigint")


def plan_mix(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per mix and source: ``mix, src, share, repeats, have, total, want,
    whole, rest``. ``sizes`` has ``src, have`` (bounded by the sources)."""
    share = F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0))
    repeats = F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0))
    t = targets.groupBy(F.col("mix_name").alias("mix"), clean_source(F.col("source")).alias("src")).agg(
        F.sum(share).alias("share"), F.max(repeats).alias("repeats")
    )
    t = t.join(sizes, "src", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    can = F.when((F.col("have") > 0) & (F.col("share") > 0), F.col("have") * F.col("repeats") / F.col("share"))
    top = F.min(can).over(Window.partitionBy("mix"))
    t = t.withColumn("total", F.coalesce(F.lit(total).cast("double"), top, F.lit(0.0)))
    want = F.least(F.col("share") * F.col("total"), (F.col("have") * F.col("repeats")).cast("double"))
    t = t.withColumn("want", want)
    whole = F.when(F.col("have") > 0, F.floor(F.col("want") / F.col("have") + 1e-9)).otherwise(0).cast("int")
    t = t.withColumn("whole", F.least(whole, F.col("repeats").cast("int")))
    return t.withColumn("rest", F.greatest(F.col("want") - F.col("whole") * F.col("have"), F.lit(0.0)))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash, equal on every run."""
    return (F.pmod(F.xxhash64(*parts), F.lit(2**52)).cast("double") + 0.5) / float(2**52)


def draw(tokens: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0) -> DataFrame:
    """``mix, src, id, tokens, copies``: every drawn document of every mix."""
    tokens = tokens.where(F.col("tokens") > 0)
    stats = tokens.groupBy("src").agg(F.sum("tokens").alias("have"), F.sum(F.pow("tokens", F.lit(1.5))).alias("w"))
    plan = plan_mix(stats.select("src", "have"), targets, total)
    plan = plan.join(stats.select("src", "w"), "src").where(F.col("want") > 0)
    plan = plan.select("mix", "src", "whole", "rest", (F.col("rest") / F.col("w")).alias("c"), "repeats")
    rows = tokens.join(plan, "src")  # as many rows per document as mixes name its source
    # inclusion grows with the square root of the size; expected size = rest
    pi = F.least(F.greatest(F.col("c") * F.sqrt("tokens"), F.lit(1e-9)), F.lit(1 - 1e-9))
    u = uniform(F.col("mix"), F.col("id").cast("string"), F.lit(seed))
    rows = rows.withColumn("q", (u / (1 - u)) / (pi / (1 - pi)))
    drawn = rows.where((F.col("rest") > 0) & (F.col("whole") < F.col("repeats")))
    drawn = drawn.withColumn("b", bucket_of(F.log2("q")))
    drawn = running_total(drawn, ["mix", "src"], "b", [F.col("q"), F.col("id")], F.col("tokens"), "before")
    # the last one is taken when that brings the size nearer to what is needed
    drawn = drawn.where(F.col("before") + F.col("tokens") / 2 <= F.col("rest"))
    extra = drawn.select("mix", "src", "id", "tokens", F.lit(1).alias("copies"))
    sure = rows.where(F.col("whole") > 0).select("mix", "src", "id", "tokens", F.col("whole").alias("copies"))
    both = sure.unionByName(extra)
    return both.groupBy("mix", "src", "id", "tokens").agg(F.sum("copies").cast("int").alias("copies"))


def mix_report(tokens: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0) -> DataFrame:
    """Per mix and source: target and actual shares, sizes and copies."""
    drawn = draw(tokens, targets, total, seed)
    got = drawn.groupBy(F.col("mix").alias("m"), F.col("src").alias("s")).agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("got"), F.count("*").alias("docs"), F.max("copies").alias("most")
    )
    stats = tokens.groupBy("src").agg(F.sum("tokens").alias("have"))
    plan = plan_mix(stats, targets, total)
    rows = plan.join(got, (F.col("mix") == F.col("m")) & (F.col("src") == F.col("s")), "left")
    size = F.coalesce(F.col("got"), F.lit(0))
    return rows.select(
        "mix", "src", F.col("share").alias("target_share"), F.col("have").cast("bigint").alias("have_tokens"),
        F.round(F.col("total")).cast("bigint").alias("total_tokens"), F.round("want").cast("bigint").alias("wanted_tokens"),
        size.cast("bigint").alias("tokens"), F.coalesce("docs", F.lit(0)).cast("bigint").alias("n_docs"),
        F.coalesce("most", F.lit(0)).cast("int").alias("most_copies"),
        F.round(size / F.nullif(F.col("total"), F.lit(0.0)), 6).alias("share_of_total"),
        F.round(size / F.nullif(F.sum(size).over(Window.partitionBy("mix")), F.lit(0)), 6).alias("share_reached"),
    )

"""Keyword, semantic and hybrid ranking.

Keyword: BM25 over chunks (k1 1.2, b 0.75), statistics over all chunks of the
given frame, the best chunk per document. Semantic: exact cosine, the best
chunk per document. Hybrid: reciprocal rank fusion. Per-document argmin/argmax
are partial aggregations; top lists are TakeOrderedAndProject.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.columns import once
from lodestar.operators.index import TextIndex, phrases_of, score, tokens_of
from lodestar.operators.index import postings as index_rows

#: Rows of a top list up to which it is broadcast.
FEW = 20_000


def postings(chunks: DataFrame, chunk_id: str = "chunk_id", tokenizer: str = "porter") -> DataFrame:
    """``term, chunk_id, tf, positions`` of every token."""
    rows = chunks.where(F.col("text").isNotNull()).select(F.lit("").alias("doc_id"), F.col(chunk_id).alias("chunk_id"), tokens_of(F.col("text"), tokenizer).alias("w"))
    return index_rows(rows, "w").select("term", "chunk_id", F.size("positions").cast("bigint").alias("tf"), "positions")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if a list is known to be short; longer ones are left to the planner."""
    return F.broadcast(df) if rows <= FEW else df


def _occurrences(tokens: Column, phrase: list[str]) -> Column:
    """How often a phrase (mostly one word) stands in the tokens."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens, lambda t: t == phrase[0]))
    text = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))
    key = " " + "  ".join(phrase) + " "
    return ((F.length(text) - F.length(F.replace(text, F.lit(key), F.lit("")))) / len(key)).cast("int")


def bm25(chunks: DataFrame, query: str, tokenizer: str = "porter") -> DataFrame:
    """``doc_id, chunk_id, bm25`` of matching chunks of a frame without index;
    lower is better.

    One scan: token counts of the query's terms per chunk. The statistics are
    one row, joined to the matching chunks."""
    phrases = phrases_of(query, tokenizer)
    if not phrases:
        return chunks.select("doc_id", "chunk_id", F.lit(0.0).alias("bm25")).limit(0)
    counted = once(chunks.where(F.col("text").isNotNull()).select("doc_id", "chunk_id", "text"), {"__t": tokens_of(F.col("text"), tokenizer)})
    counted = counted.select(
        "doc_id", "chunk_id", F.size("__t").alias("len"), *[_occurrences(F.col("__t"), p).alias(f"f{i}") for i, p in enumerate(phrases)]
    )
    stats = counted.agg(
        F.count("*").alias("n"), F.avg("len").alias("avgdl"), *[F.sum((F.col(f"f{i}") > 0).cast("int")).alias(f"n{i}") for i in range(len(phrases))]
    ).withColumn("__one", F.lit(1))
    hit = sum((F.col(f"f{i}") for i in range(len(phrases))), F.lit(0)) > 0
    rows = counted.where(hit).withColumn("__one", F.lit(1)).join(F.broadcast(stats), "__one")  # one row
    return rows.select("doc_id", "chunk_id", score(len(phrases)).alias("bm25"))


def keyword_candidates(
    chunks: DataFrame, query: str, depth: int = 100, eligible: DataFrame | None = None, tokenizer: str = "porter", index: TextIndex | None = None,
) -> DataFrame:
    """``doc_id, keyword_rank, keyword_text, bm25``: the best ``depth`` documents,
    found in ``index`` where there is one. ``eligible`` (``doc_id``) filters before
    the cut, never the statistics; texts are fetched for the winners only."""
    hits = index.bm25(query) if index else bm25(chunks, query, tokenizer)
    if eligible is not None:
        hits = hits.join(eligible.select("doc_id"), "doc_id", "left_semi")
    best = hits.groupBy("doc_id").agg(F.min(F.struct("bm25", "chunk_id")).alias("x"))
    top = best.select("doc_id", "x.bm25", "x.chunk_id").orderBy("bm25", "doc_id").limit(depth)
    rank = F.row_number().over(Window.orderBy("bm25", "doc_id"))  # at most ``depth`` rows
    ranked = top.select("doc_id", "chunk_id", rank.alias("keyword_rank"), "bm25")
    return _with_text(chunks, ranked, depth, "keyword_text").select("doc_id", "keyword_rank", "keyword_text", "bm25")


def _with_text(chunks: DataFrame, ranked: DataFrame, depth: int, name: str) -> DataFrame:
    texts = chunks.select(F.col("chunk_id").alias("__c"), F.col("text").alias(name))
    return texts.join(_few(ranked, depth), F.col("__c") == F.col("chunk_id"))


def cosine_udf(query: list[float]):
    """Dot product with a fixed vector, in float64, a batch at a time."""
    q = np.asarray(query, np.float64)

    @F.arrow_udf("double")
    def dot(v: pa.Array) -> pa.Array:
        out = np.full(len(v), np.nan)
        fits = (pc.list_value_length(v).to_numpy(zero_copy_only=False) == len(q)) & (np.diff(v.offsets.to_numpy()) == len(q))
        if fits.any():
            rows = np.flatnonzero(fits)
            flat = v.values.to_numpy(zero_copy_only=False)
            out[rows] = flat[v.offsets.to_numpy()[rows][:, None] + np.arange(len(q))].astype(np.float64) @ q
        return pa.array(out, mask=np.isnan(out))

    return dot


def cosine_scores(chunks: DataFrame, query: list[float]) -> DataFrame:
    """``doc_id, chunk_id, cosine`` of chunks of the query's length."""
    return chunks.select("doc_id", "chunk_id", cosine_udf(query)("vec").alias("cosine")).where(F.col("cosine").isNotNull())


def semantic_candidates(chunks: DataFrame, query: list[float], depth: int = 100, eligible: DataFrame | None = None) -> DataFrame:
    """``doc_id, semantic_rank, semantic_text``; texts are fetched for the
    ``depth`` winners only."""
    scored = cosine_scores(chunks, query)
    if eligible is not None:
        scored = scored.join(eligible.select("doc_id"), "doc_id", "left_semi")
    best = scored.groupBy("doc_id").agg(F.max(F.struct(F.col("cosine"), (-F.col("chunk_id")).alias("k"))).alias("x"))
    top = best.select("doc_id", F.col("x.cosine").alias("cosine"), (-F.col("x.k")).alias("chunk_id"))
    top = top.orderBy(F.desc("cosine"), "doc_id").limit(depth)
    ranked = top.withColumn("semantic_rank", F.row_number().over(Window.orderBy(F.desc("cosine"), "doc_id")))
    return _with_text(chunks, ranked, depth, "semantic_text").select("doc_id", "semantic_rank", "semantic_text", "cosine")


def fuse(keyword: DataFrame | None, semantic: DataFrame | None, k: int = 60, top: int = 10) -> DataFrame:
    """``id, score, text, keyword_rank, semantic_rank``: reciprocal rank fusion;
    a missing rank is 0 and adds nothing; the semantic text wins."""
    empty = "doc_id string, {0}_rank int, {0}_text string"
    some = keyword if keyword is not None else semantic
    spark = some.sparkSession
    kw = keyword.select("doc_id", "keyword_rank", "keyword_text") if keyword is not None else spark.createDataFrame([], empty.format("keyword"))
    sem = semantic.select("doc_id", "semantic_rank", "semantic_text") if semantic is not None else spark.createDataFrame([], empty.format("semantic"))
    both = kw.join(sem, "doc_id", "full_outer")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    return (
        both.select(
            F.col("doc_id").alias("id"),
            (part("keyword_rank") + part("semantic_rank")).alias("score"),
            F.coalesce("semantic_text", "keyword_text").alias("text"),
            F.coalesce("keyword_rank", F.lit(0)).alias("keyword_rank"),
            F.coalesce("semantic_rank", F.lit(0)).alias("semantic_rank"),
        )
        .orderBy(F.desc("score"), "id")
        .limit(top)
    )


MODES = ("hybrid", "keyword", "semantic")


def search(
    chunks: DataFrame, query: str, vector: list[float] | None = None, mode: str = "hybrid", top: int = 10, k: int = 60,
    depth: int = 100, eligible: DataFrame | None = None, attributes: DataFrame | None = None, tokenizer: str = "porter",
    index: TextIndex | None = None,
) -> DataFrame:
    """The search pipeline over ``chunks`` (``doc_id, chunk_id, text, vec``).
    ``attributes`` (``doc_id, attributes``) are attached to the final rows."""
    if not query.strip():
        raise ValueError("query text is empty")
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    kw = keyword_candidates(chunks, query, depth, eligible, tokenizer, index) if mode != "semantic" else None
    sem = semantic_candidates(chunks, vector, depth, eligible) if mode != "keyword" and vector is not None else None
    if kw is None and sem is None:
        raise ValueError("a semantic search needs a query vector")
    out = fuse(kw, sem, k if k > 0 else 60, top if top > 0 else 10)
    if attributes is None:
        return out
    return attributes.join(_few(out, top if top > 0 else 10), F.col("doc_id") == F.col("id")).drop("doc_id")

"""A stored inverted index and keyword search over it.

The index is a table of postings, ``doc_id, chunk_id, len, term, positions``, in
folders by term bucket, sorted by term: a query reads the folders of its terms
and, within them, the row groups that hold them. The corpus is not read. The two
numbers that BM25 needs of the whole corpus, chunks and tokens, are known when
the index is opened.

Building is one map over the chunks and one shuffle by term bucket; the rows of a
term that a third of all chunks hold spread over as many tasks as the index has
parts.

Defined results:
* null texts have no postings and do not count as chunks; texts without tokens
  count with length 0;
* repeated chunk rows are chunks of their own only under ids of their own;
* a term of several tokens (an underscore in the query) is a phrase;
* empty tables give an index without postings and searches without hits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import index_tokens, plain_tokens, porter_tokens, query_terms

K1, B = 1.2, 0.75
TERM_BUCKETS = 64
POSTINGS = "doc_id string, chunk_id bigint, len int, term string, positions array<int>"


def bucket_of_term(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(TERM_BUCKETS)).cast("int")


def tokens_of(text: Column, tokenizer: str) -> Column:
    return porter_tokens(text) if tokenizer == "porter" else plain_tokens(text)


def phrases_of(query: str, tokenizer: str) -> list[list[str]]:
    """The query's terms as lists of index tokens (mostly one each)."""
    terms = query_terms(query)
    found = [index_tokens(t) if tokenizer == "porter" else [w for w in t.split("_") if w] for t in terms]
    return [p for p in found if p]


def postings(chunks: DataFrame, tokens: str) -> DataFrame:
    """Postings of ``doc_id, chunk_id`` and the token column ``tokens``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, chunk, words in zip(b["doc_id"], b["chunk_id"], b["w"]):
                at: dict[str, list[int]] = {}
                for i, w in enumerate(words if words is not None else ()):
                    at.setdefault(w, []).append(i)
                out += [(doc, chunk, len(words), w, places) for w, places in at.items()]
            yield pd.DataFrame(out, columns=["doc_id", "chunk_id", "len", "term", "positions"])

    rows = chunks.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("chunk_id").cast("bigint").alias("chunk_id"), F.col(tokens).alias("w"))
    return rows.mapInPandas(run, POSTINGS)


def write_postings(rows: DataFrame, path: str, parts: int = 1, by: tuple[str, ...] = ()) -> None:
    """Writes postings in folders by ``by`` and term bucket; every bucket is
    written by at most ``parts`` tasks."""
    rows = rows.withColumn("t", bucket_of_term(F.col("term")))
    spread = [F.pmod(F.xxhash64("chunk_id"), F.lit(parts))] if parts > 1 else []
    rows = rows.repartition(*by, "t", *spread).sortWithinPartitions(*by, "t", "term")
    rows.write.partitionBy(*by, "t").parquet(path)


@dataclass(frozen=True)
class TextIndex:
    """An opened index: its postings (with the column ``t``), the number of
    chunks and of their tokens."""

    rows: DataFrame
    chunks: int
    tokens: int
    tokenizer: str = "porter"

    def bm25(self, query: str) -> DataFrame:
        """``doc_id, chunk_id, bm25`` of matching chunks; lower is better."""
        phrases = phrases_of(query, self.tokenizer)
        if not phrases:
            return self.rows.select("doc_id", "chunk_id", F.lit(0.0).alias("bm25")).limit(0)
        words = sorted({w for p in phrases for w in p})
        buckets = sorted({zlib.crc32(w.encode()) % TERM_BUCKETS for w in words})
        rows = self.rows.where(F.col("t").isin(buckets) & F.col("term").isin(words))
        at = {w: F.max(F.when(F.col("term") == w, F.col("positions"))) for w in words}
        places = rows.groupBy("doc_id", "chunk_id").agg(F.max("len").alias("len"), *[c.alias(f"p{i}") for i, c in enumerate(at.values())])
        place = {w: F.col(f"p{i}") for i, w in enumerate(at)}
        counted = places.select("doc_id", "chunk_id", "len", *[_times(p, place).alias(f"f{i}") for i, p in enumerate(phrases)])
        found = [F.sum((F.col(f"f{i}") > 0).cast("bigint")).alias(f"n{i}") for i in range(len(phrases))]
        stats = counted.agg(*found).withColumns({"n": F.lit(self.chunks), "avgdl": F.lit(self.tokens / max(self.chunks, 1)), "__one": F.lit(1)})
        hit = counted.where(sum((F.col(f"f{i}") for i in range(len(phrases))), F.lit(0)) > 0).withColumn("__one", F.lit(1))
        rows = hit.join(F.broadcast(stats), "__one")  # one row
        return rows.select("doc_id", "chunk_id", score(len(phrases)).alias("bm25"))


def _times(phrase: list[str], place: dict[str, Column]) -> Column:
    """How often the words of a phrase stand one after the other."""
    starts = place[phrase[0]]
    for k, w in enumerate(phrase[1:], 1):
        back = F.lit(k)
        starts = F.array_intersect(starts, F.transform(place[w], lambda x: x - back))  # noqa: B023 (called at once)
    return F.when(starts.isNotNull(), F.size(starts)).otherwise(F.lit(0))


def score(terms: int) -> Column:
    """BM25 of ``f0.. n0.. n avgdl len``, negated."""
    total = F.lit(0.0)
    for i in range(terms):
        idf = F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        f = F.col(f"f{i}")
        total = total + F.when(idf <= 0, 1e-6).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return -total


def build_index(chunks: DataFrame, path: str, tokenizer: str = "porter", parts: int = 1) -> TextIndex:
    """Indexes ``doc_id, chunk_id, text`` below ``path`` and opens the index."""
    spark = chunks.sparkSession
    rows = chunks.where(F.col("text").isNotNull()).select("doc_id", "chunk_id", tokens_of(F.col("text"), tokenizer).alias("w"))
    rows.select("doc_id", "chunk_id", "w").write.parquet(f"{path}/tokens")
    rows = spark.read.parquet(f"{path}/tokens")
    sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("tokens")).first()
    write_postings(postings(rows, "w"), f"{path}/postings", parts)
    return TextIndex(open_postings(spark, [f"{path}/postings"]), sizes["n"], sizes["tokens"], tokenizer)


def open_postings(spark, paths: list[str]) -> DataFrame:
    return spark.read.schema(f"{POSTINGS}, t int").parquet(*paths)

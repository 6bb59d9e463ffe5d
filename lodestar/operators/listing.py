"""Listing, grouping and counting documents over their attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.filters import Filter, attribute, rendered


def _page(df: DataFrame, limit: int, offset: int) -> DataFrame:
    """``limit`` 0 is 50, below 0 unbounded."""
    df = df.offset(offset) if offset > 0 else df
    return df if limit < 0 else df.limit(limit or 50)


def _kept(docs: DataFrame, where: Filter | None) -> DataFrame:
    return docs if where is None else docs.where(where.column(F.col("attrs")))


def _sort_keys(attrs: Column, key: str) -> list[Column]:
    a = attribute(attrs, key)
    return [a.kind, a.number, a.text]


def _order(cols: list[str], ascending: bool, nulls_last: bool) -> list[Column]:
    out = []
    for c in cols:
        x = F.col(c)
        if ascending:
            out.append(x.asc_nulls_last() if nulls_last else x.asc_nulls_first())
        else:
            out.append(x.desc_nulls_last())
    return out


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("ns", "doc_id").agg(F.count("*").alias("n_chunks"))


def with_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    counts = chunk_counts(chunks).withColumnsRenamed({"ns": "__ns", "doc_id": "__doc"})
    on = (F.col("ns") == F.col("__ns")) & (F.col("id") == F.col("__doc"))
    return docs.join(counts, on, "left").withColumn("chunks", F.coalesce("n_chunks", F.lit(0))).drop("__ns", "__doc", "n_chunks")


def list_documents(
    docs: DataFrame, chunks: DataFrame, where: Filter | None = None, sort: str | None = "created", ascending: bool = False,
    limit: int = 0, offset: int = 0,
) -> DataFrame:
    """``id, attributes, chars, chunks``: newest first, undated last in either
    direction, equal ones by id. Chunks are counted for the page only."""
    rows = _kept(docs, where)
    order: list[Column] = []
    if sort:
        a, b, c = _sort_keys(F.col("attrs"), sort)
        rows = rows.withColumns({"__k": a, "__n": b, "__t": c})
        order = [F.col("__k").isNull(), *_order(["__k", "__n", "__t"], ascending, True)]
    page = _page(rows.orderBy(*order, "id"), limit, offset)
    out = with_chunks(page.select("ns", "id", F.col("attrs").alias("attributes"), F.length("text").alias("chars"), *(["__k", "__n", "__t"] if sort else [])), chunks)
    return out.orderBy(*order, "id").select("id", "attributes", "chars", "chunks")


def group_documents(
    docs: DataFrame, chunks: DataFrame, key: str, where: Filter | None = None, sort: str | None = "created",
    ascending: bool = False, extra: tuple[str, ...] = (), limit: int = 0, offset: int = 0,
) -> DataFrame:
    """``key, documents, chunks, <sort>, <extra>...`` per value of an attribute:
    the greatest sort value and the least extras. Without a value: no group.
    Undated groups are last when descending, first when ascending."""
    rows = with_chunks(_kept(docs, where).select("ns", "id", "attrs"), chunks)
    a = attribute(F.col("attrs"), key)
    rows = rows.withColumns({"__gk": a.kind, "__gn": a.number, "__gt": a.text, "key": rendered(F.col("attrs"), key)}).where(F.col("__gk").isNotNull())
    picks = [F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.min("key").alias("key")]
    if sort:
        picks.append(F.max(F.when(attribute(F.col("attrs"), sort).kind.isNotNull(), F.struct(*[x.alias(n) for x, n in zip(_sort_keys(F.col("attrs"), sort), "knt")], rendered(F.col("attrs"), sort).alias("v")))).alias("__s"))
    picks += [F.min(rendered(F.col("attrs"), e)).alias(e) for e in extra]
    got = rows.groupBy("__gk", "__gn", "__gt").agg(*picks)
    order = []
    if sort:
        order = [F.col("__s").asc_nulls_first() if ascending else F.col("__s").desc_nulls_last()]
        got = got.withColumn(sort, F.col("__s.v"))
    page = _page(got.orderBy(*order, "key"), limit, offset)
    return page.select("key", "documents", "chunks", *([sort] if sort else []), *extra)


def count_documents(docs: DataFrame, where: Filter | None = None) -> DataFrame:
    return _kept(docs, where).agg(F.count("*").alias("n"))


def count_groups(docs: DataFrame, key: str, where: Filter | None = None) -> DataFrame:
    """Exact number of distinct values (1 and '1' differ)."""
    a = attribute(F.col("attrs"), key)
    rows = _kept(docs, where).select(a.kind.alias("k"), a.number.alias("x"), a.text.alias("t")).where(F.col("k").isNotNull())
    return rows.distinct().agg(F.count("*").alias("n"))


def namespace_stats(config: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``name, embedder_id, dims, created_at, documents, chunks`` by name."""
    d = docs.groupBy(F.col("ns").alias("__d")).agg(F.count("*").alias("documents"))
    c = chunks.groupBy(F.col("ns").alias("__c")).agg(F.count("*").alias("chunks"))
    out = config.join(d, F.col("name") == F.col("__d"), "left").join(c, F.col("name") == F.col("__c"), "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return out.select("name", "embedder_id", "dims", "created_at", zero("documents"), zero("chunks")).orderBy("name")

"""All core queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar import queries_ingest, queries_records, queries_search

QUERIES = {**queries_search.QUERIES, **queries_records.QUERIES, **queries_ingest.QUERIES}
ORACLE = {**queries_search.ORACLE, **queries_records.ORACLE, **queries_ingest.ORACLE}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 top ten documents."""
    return QUERIES["bm25_top10"](spark, folder)

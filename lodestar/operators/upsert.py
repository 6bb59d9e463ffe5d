"""Incremental upsert and delete by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import content_hash


def hashed(docs: DataFrame) -> DataFrame:
    """``ns, id, text, attrs, hash`` with empty attributes as ``{}``."""
    attrs = F.when(F.col("attrs") != "", F.col("attrs")).otherwise(F.lit("{}"))
    out = docs.select("ns", "id", "text", F.coalesce(attrs, F.lit("{}")).alias("attrs"))
    return out.withColumn("hash", content_hash(F.col("text"), F.col("attrs")))


def last_of_each(incoming: DataFrame, order: str) -> DataFrame:
    """Of several rows with one id the last given wins."""
    w = Window.partitionBy("ns", "id").orderBy(F.col(order).desc())
    return incoming.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1).drop("__r")


def classify(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows with ``action`` written or skipped (equal hash stored)."""
    known = stored.select(F.col("ns").alias("__n"), F.col("id").alias("__i"), F.col("hash").alias("__h"))
    on = (F.col("ns") == F.col("__n")) & (F.col("id") == F.col("__i")) & (F.col("hash") == F.col("__h"))
    rows = hashed(incoming).join(known.distinct(), on, "left")
    return rows.withColumn("action", F.when(F.col("__h").isNull(), "written").otherwise("skipped")).drop("__n", "__i", "__h")


def merge(stored: DataFrame, written: DataFrame, columns: list[str] = ("ns", "id")) -> DataFrame:
    """Stored rows without those written anew, and the written ones."""
    keep = stored.join(written.select(*columns).distinct(), list(columns), "left_anti")
    return keep.unionByName(written.select(*stored.columns))


def delete_ids(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return rows.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_anti")

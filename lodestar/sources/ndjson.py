"""Newline-delimited documents, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.columns import has_text

LONGEST_LINE = 10 * 1024 * 1024


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``id, text, attrs, error``: ``error`` is null for a document. A line
    needs non-empty texts ``id`` and ``text``; blank lines are left out."""
    raw = F.col(column)
    v = F.try_parse_json(raw)
    kind = F.schema_of_variant(v)
    text = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string"))
    ident, body = text("id"), text("text")
    attrs = F.get_json_object(raw, "$.attributes")
    error = (
        F.when(F.octet_length(raw) > LONGEST_LINE, "line too long")
        .when(v.isNull(), "malformed JSON")
        .when(~kind.startswith("OBJECT"), "not an object")
        .when(F.coalesce(ident, F.lit("")) == "", "missing id")
        .when(F.coalesce(body, F.lit("")) == "", "missing text")
    )
    return lines.where(has_text(raw)).select(
        "*", ident.alias("id"), body.alias("text"), F.coalesce(attrs, F.lit("{}")).alias("attrs"), error.alias("error")
    )


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path)).drop("value")


def stream_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.readStream.text(path)).drop("value")

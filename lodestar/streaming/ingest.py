"""Continuous ingest: a stream of documents into a namespace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.plans.engine import Namespace
from lodestar.sources.ndjson import stream_ndjson


def start_ingest(stream: DataFrame, namespace: Namespace, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Upserts every micro-batch of ``id, text, attrs``. A batch replayed after
    a failure is skipped by content hash, so results are exactly once."""

    def write(batch: DataFrame, _: int) -> None:
        namespace.write(batch.select("id", "text", "attrs"))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_ndjson(spark: SparkSession, path: str, namespace: Namespace, checkpoint: str, once: bool = True) -> StreamingQuery:
    good = stream_ndjson(spark, path).where(F.col("error").isNull())
    return start_ingest(good, namespace, checkpoint, once)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window, final once the watermark has passed."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    )

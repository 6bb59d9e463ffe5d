"""Queries of reading, streaming and the engine's life cycle: tables are written in
the form that is to be read, below the shared checkpoint folder, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.embed import HashEmbedder
from lodestar.plans.engine import Engine
from lodestar.session import Kept
from lodestar.sources.ndjson import read_ndjson, stream_ndjson
from lodestar.streaming.ingest import windowed_counts
from lodestar.tables import load


def _lines(spark: SparkSession, d: str) -> str:
    """The folder of the docs table as NDJSON, with two bad lines added."""
    docs = load(spark, d, "docs")
    line = F.to_json(F.struct("id", "text", F.parse_json("attrs").alias("attributes")))
    bad = spark.createDataFrame([("{",), ('{"id": "no text"}',)], "value string")
    path = f"{Kept(spark).folder('ndjson')}/lines"
    docs.select(line.alias("value")).unionByName(bad).write.text(path)
    return path


def read_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of NDJSON files, batch."""
    rows = read_ndjson(spark, _lines(spark, d)).where(F.col("error").isNull())
    return rows.select("id", "text", F.to_json(F.parse_json("attrs")).alias("attrs"))


def read_bad_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are no document, by reason."""
    rows = read_ndjson(spark, _lines(spark, d)).where(F.col("error").isNotNull())
    return rows.groupBy("error").agg(F.count("*").alias("n"))


def stream_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same documents through a stream into a table."""
    kept = Kept(spark)
    folder = kept.folder("stream")
    good = stream_ndjson(spark, _lines(spark, d)).where(F.col("error").isNull()).select("id", "text")
    writer = good.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("id string, text string").parquet(f"{folder}/rows")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and hour from a stream: the windows that are final once the
    watermark has passed them."""
    folder = Kept(spark).folder("events")
    load(spark, d, "events").select("ts", "event_type", "value").write.parquet(f"{folder}/in")
    # one event far ahead, read last, moves the watermark past all others
    ahead = spark.sql("SELECT timestamp'2999-01-01' AS ts, 'end' AS event_type, 0.0D AS value")
    stream = lambda: spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{folder}/in")

    def run() -> None:
        out = windowed_counts(stream()).select(F.col("window.start").alias("hour"), "event_type", "n", "total")
        writer = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    run()
    ahead.write.mode("append").parquet(f"{folder}/in")
    run()
    rows = spark.read.schema("hour timestamp, event_type string, n bigint, total double").parquet(f"{folder}/out")
    return rows.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def engine_documents(spark: SparkSession, d: str) -> DataFrame:
    """What a namespace holds after a write, a write of changed and unchanged
    documents, and a delete."""
    docs = load(spark, d, "docs").select("id", "text", "attrs").where(F.col("text").isNotNull())
    ends = docs.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()  # one row
    ns = Engine(spark, f"{Kept(spark).folder('engine')}/db", HashEmbedder(16)).create_namespace("all", 500, 50)
    ns.write(docs)
    ns.write(docs.withColumn("text", F.when(F.col("id").endswith("1"), F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))))
    ns.delete([ends["a"], ends["b"]])
    return ns.docs().select("id", "text")


QUERIES = {f.__name__: f for f in (read_documents, read_bad_lines, stream_documents, stream_windows, engine_documents)}

_GOOD = "FROM docs WHERE id <> '' AND text <> ''"
ORACLE = {
    "read_documents": f"SELECT id, text, attrs {_GOOD}",
    "read_bad_lines": "SELECT error, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'malformed JSON' AS error, 1 AS n UNION ALL SELECT 'missing text', 1 + (SELECT count(*) FROM docs WHERE coalesce(text, '') = '')) GROUP BY error",
    "stream_documents": f"SELECT id, text {_GOOD}",
    "stream_windows": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
    "engine_documents": """SELECT id, CASE WHEN id LIKE '%1' THEN text || ' edited' ELSE text END AS text FROM docs
        WHERE text IS NOT NULL AND id NOT IN (SELECT min(id) FROM docs WHERE text IS NOT NULL) AND id NOT IN (SELECT max(id) FROM docs WHERE text IS NOT NULL)""",
}

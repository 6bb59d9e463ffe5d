"""Queries of the record-level operators (nested records, timestamps)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.instants import CANONICAL, CONVENTIONS, NUMBER, SHAPES, ZONE_LETTERS, normalize_timestamps
from lodestar.operators.nested import chat_export_tables, chat_files, unfold_json
from lodestar.tables import load


def _flat(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return chat_export_tables(load(spark, d, "chatgpt_convs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return chat_files(load(spark, d, "chatgpt_convs")).select("rec_id", "node_id", "file_id")


def p5_conversations(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d)["conversations"].select(
        "sk", "rec_id", "conversation_id", "id", "title", "create_time", "device_id"
    )


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d)["nodes"].select("sk", "parent_sk", "node_id", "parent")


def p5_messages(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d)["messages"]


def p5_parts(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d)["parts"].select("parent_sk", F.col("ord").cast("int").alias("ord"), "part")


def p5_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d)["metadata"].select("parent_sk", "map_key", "value")


def p5_children(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d)["children"].select("parent_sk", F.col("ord").cast("int").alias("ord"), "child_id")


def p5_part_objects(spark: SparkSession, d: str) -> DataFrame:
    """JSON objects among the parts, unfolded under their merged schema."""
    got = unfold_json(_flat(spark, d)["parts"], "part", "part")
    if not got:
        return spark.createDataFrame([], "parent_sk string, content_type string")
    return got["part"].select("parent_sk", *[c for c in ("content_type", "asset_pointer", "text") if c in got["part"].columns])


def _child(spark: SparkSession, d: str, name: str, column: str) -> DataFrame:
    """A child table of the unfolded part objects: parent, ordinal and a column."""
    got = unfold_json(_flat(spark, d)["parts"], "part", "part").get(name)
    if got is None or column not in got.columns:
        return spark.createDataFrame([], f"parent_sk string, ord int, {column} string")
    return got.select("parent_sk", F.col("ord").cast("int").alias("ord"), column)


def p5_part_frames(spark: SparkSession, d: str) -> DataFrame:
    """Array elements two levels below a message, linked by key and ordinal."""
    return _child(spark, d, "part.frames_asset_pointers", "asset_pointer")


def p5_part_refs(spark: SparkSession, d: str) -> DataFrame:
    return _child(spark, d, "part.refs", "id")


def p5_places(spark: SparkSession, d: str) -> DataFrame:
    """References per scheme, with and without repeated exports: how the found
    files divide."""
    files = chat_files(load(spark, d, "chatgpt_convs"))
    return files.groupBy(F.coalesce(F.nullif("scheme", F.lit("")), F.lit("none")).alias("scheme")).agg(
        F.count("*").alias("n"), F.count_distinct("file_id").alias("n_files")
    )


def stamps(spark: SparkSession, d: str) -> DataFrame:
    """Every stamp of the three sources with its device's zone."""
    devices = load(spark, d, "devices").groupBy("device_id").agg(F.min("tz_name").alias("tz"))
    convs = load(spark, d, "chatgpt_convs")
    ms = lambda c: F.unix_millis(F.col(c))
    cc = load(spark, d, "cc_lines").select(
        F.lit("cc").alias("src"), F.col("line_id").cast("string").alias("rec_key"), "stamp", "device_id", ms("ingested_at").alias("near")
    )
    conv = convs.select(
        F.lit("conv").alias("src"), F.col("rec_id").cast("string").alias("rec_key"), F.col("create_time").alias("stamp"), "device_id", ms("exported_at").alias("near")
    )
    times = F.transform(F.map_entries("mapping"), lambda e: F.struct(e["key"].alias("k"), e["value"]["message"]["create_time"].alias("t")))
    msg = (
        convs.select("rec_id", "device_id", ms("exported_at").alias("near"), F.explode(times).alias("m"))
        .select(
            F.lit("msg").alias("src"), F.concat_ws("/", F.col("rec_id").cast("string"), F.col("m.k")).alias("rec_key"), F.col("m.t").alias("stamp"), "device_id", "near"
        )
    )
    rows = reduce(DataFrame.unionByName, [cc, conv, msg]).where(F.col("stamp").isNotNull())
    rows = rows.join(devices.withColumnRenamed("device_id", "dev"), F.col("device_id") == F.col("dev"), "left")
    return rows.withColumn("kind", F.concat_ws("/", "src", "device_id"))


def p6_normalized(spark: SparkSession, d: str, conventions: dict | None = CONVENTIONS) -> DataFrame:
    return normalize_timestamps(
        stamps(spark, d), "stamp", "tz", "kind", conventions=conventions, near_ms="near"
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Instants of all stamps that are not in the canonical form already.

    A slashed date that can only be day first contradicts this data's
    convention and denotes nothing: the mixture leaves it no reading."""
    return (
        p6_normalized(spark, d)
        .where(F.col("utc_ms").isNotNull() & ~F.col("canonical"))
        .select("src", "rec_key", "utc_ms")
    )


def p6_readings(spark: SparkSession, d: str) -> DataFrame:
    """Counts per source and reading when nothing is agreed beforehand."""
    return (
        p6_normalized(spark, d, None)
        .groupBy("src", F.coalesce("reading", F.lit("none")).alias("reading"))
        .agg(F.count("*").alias("n"), F.sum(F.col("ambiguous").cast("bigint")).alias("n_ambiguous"))
    )


QUERIES = {
    f.__name__: f
    for f in (
        p5_found, p5_conversations, p5_nodes, p5_messages, p5_parts, p5_metadata, p5_children, p5_part_objects, p5_part_frames,
        p5_part_refs, p5_places,
        p6_found, p6_readings,
    )
}

_NODE = """WITH n AS (SELECT rec_id, unnest(map_entries(mapping)) AS e FROM chatgpt_convs)"""
_PARTS = _NODE + """, v AS (SELECT rec_id || '/mapping/' || e.key AS m, e.value.message.content.parts AS parts, unnest(range(len(e.value.message.content.parts))) AS i FROM n),
    p AS (SELECT m || '/message_content_parts/' || i AS sk, parts[i + 1] AS part FROM v WHERE parts[i + 1] LIKE '{%')"""

ORACLE = {
    "p5_conversations": "SELECT CAST(rec_id AS VARCHAR) AS sk, rec_id, conversation_id, id, title, create_time, device_id FROM chatgpt_convs",
    "p5_nodes": _NODE + " SELECT rec_id || '/mapping/' || e.key AS sk, CAST(rec_id AS VARCHAR) AS parent_sk, e.key AS node_id, e.value.parent AS parent FROM n",
    "p5_messages": _NODE + """ SELECT rec_id || '/mapping/' || e.key AS parent_sk, e.key AS node_id, e.value.message.id AS message_id,
        e.value.message.author."role" AS role, e.value.message.create_time AS create_time, e.value.message.content.content_type AS content_type,
        e.value.message.content."text" AS text, e.value.message.content.user_profile AS user_profile, e.value.message.content.user_instructions AS user_instructions
        FROM n WHERE e.value.message.id IS NOT NULL OR e.value.message.author."role" IS NOT NULL OR e.value.message.create_time IS NOT NULL OR e.value.message.content.content_type IS NOT NULL""",
    "p5_parts": _NODE + """ SELECT parent_sk, CAST(i AS INTEGER) AS ord, parts[i + 1] AS part FROM (
        SELECT rec_id || '/mapping/' || e.key AS parent_sk, e.value.message.content.parts AS parts, unnest(range(len(e.value.message.content.parts))) AS i FROM n)""",
    "p5_metadata": _NODE + """ SELECT parent_sk, m.key AS map_key, m.value AS value FROM (
        SELECT rec_id || '/mapping/' || e.key AS parent_sk, unnest(map_entries(e.value.message.metadata)) AS m FROM n)""",
    "p5_children": _NODE + """ SELECT parent_sk, CAST(i AS INTEGER) AS ord, c[i + 1] AS child_id FROM (
        SELECT rec_id || '/mapping/' || e.key AS parent_sk, e.value.children AS c, unnest(range(len(e.value.children))) AS i FROM n)""",
    "p5_found": _NODE + """, v AS (
        SELECT rec_id, e.key AS node_id, unnest(list_concat(
            list_filter(coalesce(e.value.message.content.parts, []), lambda x: x LIKE '{%' OR x LIKE '[%'),
            coalesce(map_values(e.value.message.metadata), []))) AS j FROM n),
        s AS (SELECT rec_id, node_id, unnest(regexp_extract_all(j, '"(?:[A-Za-z][A-Za-z0-9+.-]*://)?file-[A-Za-z0-9]{20}"')) AS r FROM v)
        SELECT DISTINCT rec_id, node_id, regexp_extract(r, '(file-[A-Za-z0-9]{20})"$', 1) AS file_id FROM s""",
    "p5_places": _NODE + """, v AS (
        SELECT rec_id, e.key AS node_id, unnest(list_concat(
            list_filter(coalesce(e.value.message.content.parts, []), lambda x: x LIKE '{%' OR x LIKE '[%'),
            coalesce(map_values(e.value.message.metadata), []))) AS j FROM n),
        s AS (SELECT rec_id, node_id, unnest(regexp_extract_all(j, '"(?:[A-Za-z][A-Za-z0-9+.-]*://)?file-[A-Za-z0-9]{20}"')) AS r FROM v),
        f AS (SELECT rec_id, node_id, regexp_extract(r, '(file-[A-Za-z0-9]{20})"$', 1) AS file_id, min(regexp_extract(r, '^"(?:([^:]*)://)?', 1)) AS scheme FROM s GROUP BY ALL)
        SELECT CASE WHEN scheme = '' THEN 'none' ELSE scheme END AS scheme, count(*) AS n, count(DISTINCT file_id) AS n_files FROM f GROUP BY 1""",
    "p5_part_frames": _PARTS + """ SELECT sk || '/json' AS parent_sk, CAST(o AS INTEGER) AS ord, part ->> ('$.frames_asset_pointers[' || o || '].asset_pointer') AS asset_pointer
        FROM (SELECT *, unnest(range(CAST(json_array_length(part, '$.frames_asset_pointers') AS BIGINT))) AS o FROM p)""",
    "p5_part_refs": _PARTS + """ SELECT sk || '/json' AS parent_sk, CAST(o AS INTEGER) AS ord, part ->> ('$.refs[' || o || '].id') AS id
        FROM (SELECT *, unnest(range(CAST(json_array_length(part, '$.refs') AS BIGINT))) AS o FROM p)""",
    "p5_part_objects": _NODE + """, v AS (SELECT rec_id || '/mapping/' || e.key AS m, e.value.message.content.parts AS parts, unnest(range(len(e.value.message.content.parts))) AS i FROM n)
        SELECT m || '/message_content_parts/' || i AS parent_sk, parts[i + 1] ->> '$.content_type' AS content_type, parts[i + 1] ->> '$.asset_pointer' AS asset_pointer, parts[i + 1] ->> '$.text' AS text
        FROM v WHERE parts[i + 1] LIKE '{%'""",
}


def _p6_sql() -> str:
    """The instants in SQL: the same notations, other functions."""
    plain = lambda x: x.replace("'", "''")
    shape = " ".join(f"WHEN regexp_matches(t, '{plain(p)}') THEN '{k}'" for k, (p, _) in SHAPES.items())
    cut = " ".join(f"WHEN '{k}' THEN regexp_replace(t, '{plain(p)}', '{r.replace('$', chr(92))}')" for k, (p, r) in SHAPES.items())
    letters = "MAP {" + ", ".join(f"'{k}': [{', '.join(str(int(h * 60)) for h in v)}]" for k, v in ZONE_LETTERS.items()) + "}"
    months = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"
    return rf"""WITH dv AS (SELECT device_id, min(tz_name) AS tz FROM devices GROUP BY device_id),
        st AS (SELECT 'cc' AS src, CAST(line_id AS VARCHAR) AS rec_key, stamp, device_id FROM cc_lines
            UNION ALL SELECT 'conv', CAST(rec_id AS VARCHAR), create_time, device_id FROM chatgpt_convs
            UNION ALL SELECT 'msg', rec_id || '/' || e.key, e.value.message.create_time, device_id FROM (SELECT rec_id, device_id, unnest(map_entries(mapping)) AS e FROM chatgpt_convs)),
        tr AS (SELECT src, rec_key, stamp, coalesce(tz, 'UTC') AS tz, regexp_replace(stamp, '^\s+|\s+$', '', 'g') AS t FROM st LEFT JOIN dv USING (device_id) WHERE stamp IS NOT NULL),
        sh AS (SELECT *, CASE {shape} WHEN regexp_matches(t, '{NUMBER}') THEN 'number' END AS shape FROM tr),
        pt AS (SELECT *, string_split(CASE shape {cut} END, '|') AS p, CASE WHEN shape = 'number' THEN TRY_CAST(t AS DECIMAL(38, 9)) END AS n FROM sh WHERE shape IS NOT NULL),
        nm AS (SELECT *, TRY_CAST(p[4] AS INT) AS h0, lower(p[8]) AS half, TRY_CAST(p[6] AS INT) AS sec,
            CASE shape WHEN 'dotted' THEN TRY_CAST(p[3] AS INT) WHEN 'named' THEN list_position({months}, lower(p[2])[1:3]) WHEN 'http' THEN list_position({months}, lower(p[2])[1:3]) ELSE TRY_CAST(p[2] AS INT) END AS mon,
            CASE shape WHEN 'dotted' THEN TRY_CAST(p[2] AS INT) ELSE TRY_CAST(p[3] AS INT) END AS dom FROM pt),
        hr AS (SELECT *, CASE WHEN half = '' THEN h0 WHEN h0 NOT BETWEEN 1 AND 12 THEN NULL WHEN half = 'a' THEN h0 % 12 ELSE h0 % 12 + 12 END AS hour FROM nm),
        wl AS (SELECT *, CASE WHEN hour < 24 AND sec < 60 AND TRY_CAST(p[5] AS INT) < 60 THEN TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d', TRY_CAST(p[1] AS INT), mon, dom, hour, TRY_CAST(p[5] AS INT), sec) AS TIMESTAMP) END AS wall FROM hr),
        lc AS (SELECT *, timezone(tz, wall) AS loc FROM wl),
        fx AS (SELECT *, epoch_ms(wall) AS wall_ms, CASE WHEN timezone(tz, loc - INTERVAL 1 HOUR) = wall THEN epoch_ms(loc - INTERVAL 1 HOUR)
            WHEN timezone(tz, loc) <> wall THEN epoch_ms(wall) - (epoch_ms(timezone(tz, loc - INTERVAL 3 HOUR)) - epoch_ms(loc - INTERVAL 3 HOUR)) ELSE epoch_ms(loc) END AS local_ms,
            regexp_replace(upper(p[9]), '^(UTC|GMT)([+-])', '\2') AS zone FROM lc),
        zn AS (SELECT *, regexp_replace(zone, '[^0-9]', '', 'g') AS dg, (wall_ms - local_ms) // 60000 AS own FROM fx),
        ut AS (SELECT *, CASE WHEN shape = 'number' THEN CASE WHEN n <= 0 THEN NULL WHEN n < 1e11 THEN CAST(floor(n * 1000) AS BIGINT) WHEN n < 1e14 THEN CAST(floor(n) AS BIGINT) WHEN n < 1e17 THEN CAST(floor(n / 1000) AS BIGINT) END
            WHEN zone = '' THEN local_ms
            WHEN zone[1] IN ('+', '-') THEN wall_ms - (CASE WHEN zone[1] = '-' THEN -1 ELSE 1 END) * (coalesce(TRY_CAST(dg[1:2] AS INT), 0) * 60 + coalesce(TRY_CAST(dg[3:4] AS INT), 0)) * 60000
            ELSE coalesce(wall_ms - list_sort(list_transform({letters}[zone], lambda m: {{'far': abs(m - own), 'm': m}}))[1].m * 60000, local_ms) END AS ms FROM zn)
        SELECT src, rec_key, CAST(ms + CASE WHEN shape = 'number' THEN 0 ELSE TRY_CAST((p[7] || '000')[1:3] AS INT) END AS BIGINT) AS utc_ms FROM ut
        WHERE ms IS NOT NULL AND NOT regexp_matches(stamp, '{CANONICAL}')"""


ORACLE["p6_found"] = _p6_sql()

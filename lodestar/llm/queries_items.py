"""Queries of problems 1 to 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.conversations import rebuild_graphs, rebuild_sessions
from lodestar.llm.neighbours import neighbours
from lodestar.llm.ranking import Score, borda_rank
from lodestar.llm.splitting import split_oversized
from lodestar.tables import load

SCORES = [Score("bm25", higher=False), Score("cosine"), Score("score")]


def p1_ranking(spark: SparkSession, d: str) -> DataFrame:
    return borda_rank(load(spark, d, "search_results"), "query_id", "id", SCORES, latest="logged_at")


#: Of three scores, a document among the first five by each stands among the
#: first fifteen of the sum: whatever precedes it is among the first five of one.
HEAD = 5 * len(SCORES)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents at the head of their query's combined ranking that every score
    puts among the first five."""
    first = [F.col(f"rank_{s.column}").between(1, 5) for s in SCORES]
    head = p1_ranking(spark, d).where(F.col("position") <= HEAD)
    return head.where(first[0] & first[1] & first[2]).select("query_id", "id")


def _conversations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    devices = load(spark, d, "devices")
    a, at = rebuild_graphs(load(spark, d, "chatgpt_convs"), devices)
    b, bt = rebuild_sessions(load(spark, d, "cc_lines"), devices)
    cols = ["source", "conv_key", "reason", "offset_ms", "clocks_ok"]
    verdicts = a.withColumn("source", F.lit("chatgpt")).select(*cols).unionByName(
        b.withColumn("source", F.lit("claude-code")).select(*cols)
    )
    cols = ["source", "conv_key", "turn_index", "role", "text", "t_ms"]
    turns = at.withColumn("source", F.lit("chatgpt")).select(*cols).unionByName(
        bt.withColumn("source", F.lit("claude-code")).select(*cols)
    )
    return verdicts, turns


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Conversations to drop, judged by their first and last turns in the order merged
    by corrected clocks. The data's rule names the reply order, never a clock: clocks
    that are infeasible are no reason."""
    return _conversations(spark, d)[0].where(F.col("reason") != "").select("source", "conv_key")


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    return _conversations(spark, d)[1]


def p2_clocks(spark: SparkSession, d: str) -> DataFrame:
    """Sender clock offsets per conversation."""
    return _conversations(spark, d)[0]


def _limits(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "ns_config").select(
        F.col("name").alias("ns"), F.col("chunk_size").alias("size"), F.col("chunk_over").alias("overlap")
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Stored chunks that come out in more than one piece under their
    namespace's limit (or in one that no cut can bring under it)."""
    chunks = load(spark, d, "chunks").select("id", "ns", "text").join(_limits(spark, d), "ns")
    pieces = split_oversized(chunks, "text", "size", "overlap")
    cut = (F.col("n_pieces") > 1) | (F.col("piece_bytes") > F.col("size"))
    return pieces.where(cut & (F.col("ord") == 0)).select(F.col("id").alias("chunk_id"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every document in pieces under its namespace's limit."""
    docs = load(spark, d, "docs").select("ns", "id", "text").join(_limits(spark, d), "ns", "left")
    return split_oversized(docs, "text", "size", "overlap").select("ns", "id", "ord", "piece", "piece_bytes", "n_pieces")


def p3_limits(spark: SparkSession, d: str) -> DataFrame:
    """Per document: whether all pieces keep to the limit, stand in the text, lose
    nothing but white space between them and overlap by no more than asked."""
    size, over = F.coalesce("size", F.lit(1000)), F.coalesce("overlap", F.lit(0))
    docs = load(spark, d, "docs").select("ns", "id", "text").join(_limits(spark, d), "ns", "left")
    rows = split_oversized(docs, "text", "size", "overlap")
    squeezed = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    bare = F.length(squeezed(F.col("text")))
    per = rows.groupBy("ns", "id").agg(
        F.max("piece_bytes").alias("most"), F.bool_and(F.instr("text", F.col("piece")) > 0).alias("inside"), F.count("*").alias("n"),
        F.sum(F.length(squeezed(F.col("piece")))).alias("letters"), F.max(bare).alias("bare"), F.max(size).alias("size"), F.max(over).alias("over"),
    )
    return per.select(
        "ns", "id", (F.col("most") <= F.col("size")).alias("within"), "inside",
        F.col("letters").between(F.col("bare"), F.col("bare") + (F.col("n") - 1) * F.col("over")).alias("covered"),
        (F.col("n") > 1).alias("split"),
    )


def p4_similar(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar other chunks of every usable chunk."""
    return neighbours(load(spark, d, "chunks"), "id", "vec", k=10, dims=64)


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return p4_similar(spark, d).select("id", "other", "rank")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks with cosine 0.95 or more among the ten most similar, which are
    searched for under that limit."""
    near = neighbours(load(spark, d, "chunks"), "id", "vec", k=10, dims=64, least=0.95)
    return near.select(F.least("id", "other").alias("chunk_a"), F.greatest("id", "other").alias("chunk_b")).distinct()


QUERIES = {f.__name__: f for f in (p1_ranking, p1_found, p2_found, p2_turns, p2_clocks, p3_found, p3_pieces, p3_limits, p4_found, p4_neighbours)}

_P1 = """WITH r AS (SELECT query_id, id, arg_max({'bm25': bm25, 'cosine': cosine, 'score': score}, (logged_at, bm25, cosine, score)) AS s
        FROM search_results GROUP BY ALL),
    u AS (SELECT query_id, id, count(*) OVER q AS n, s.bm25 AS a, -s.cosine AS b, -s.score AS c FROM r WINDOW q AS (PARTITION BY query_id)),
    k AS (SELECT query_id, id, n,
        CASE WHEN a IS NULL THEN 0 ELSE rank() OVER (PARTITION BY query_id ORDER BY a NULLS LAST) END AS ra, count(*) OVER (PARTITION BY query_id, a) AS ta,
        CASE WHEN b IS NULL THEN 0 ELSE rank() OVER (PARTITION BY query_id ORDER BY b NULLS LAST) END AS rb, count(*) OVER (PARTITION BY query_id, b) AS tb,
        CASE WHEN c IS NULL THEN 0 ELSE rank() OVER (PARTITION BY query_id ORDER BY c NULLS LAST) END AS rc, count(*) OVER (PARTITION BY query_id, c) AS tc FROM u)"""

_P4 = """WITH u AS (SELECT id, CAST(vec AS DOUBLE[]) AS v FROM chunks WHERE len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL)) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0)"""

ORACLE = {
    "p1_found": _P1 + " SELECT query_id, id FROM k WHERE ra BETWEEN 1 AND 5 AND rb BETWEEN 1 AND 5 AND rc BETWEEN 1 AND 5",
    "p1_ranking": _P1 + """, p AS (SELECT *, round(
            n - CASE WHEN ra = 0 THEN (n + 1) / 2 ELSE ra + (ta - 1) / 2 END + n - CASE WHEN rb = 0 THEN (n + 1) / 2 ELSE rb + (tb - 1) / 2 END
            + n - CASE WHEN rc = 0 THEN (n + 1) / 2 ELSE rc + (tc - 1) / 2 END, 9) AS points FROM k)
        SELECT query_id, id, CAST(points AS DOUBLE) AS points, CAST(row_number() OVER (PARTITION BY query_id ORDER BY points DESC, id) AS INTEGER) AS position,
            CAST(ra AS INTEGER) AS rank_bm25, CAST(rb AS INTEGER) AS rank_cosine, CAST(rc AS INTEGER) AS rank_score FROM p""",
    "p3_found": r"""SELECT c.id AS chunk_id FROM chunks c JOIN ns_config n ON c.ns = n.name
        WHERE octet_length(encode(regexp_replace(c.text, '^\s+|\s+$', '', 'g'))) > n.chunk_size""",
    "p3_limits": r"""SELECT d.ns, d.id, true AS within, true AS inside, true AS covered, octet_length(encode(regexp_replace(d.text, '^\s+|\s+$', '', 'g'))) > coalesce(n.chunk_size, 1000) AS split
        FROM docs d LEFT JOIN ns_config n ON d.ns = n.name WHERE regexp_matches(d.text, '\S')""",
    "p4_found": _P4 + """ SELECT a.id AS chunk_a, b.id AS chunk_b FROM u a JOIN u b ON a.id < b.id
        WHERE list_cosine_similarity(a.v, b.v) >= 0.95""",
    "p4_neighbours": _P4 + """, s AS (SELECT a.id, b.id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM u a JOIN u b ON a.id <> b.id),
        r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS rank FROM s)
        SELECT id, other, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
    "p2_found": r"""WITH rec AS (SELECT coalesce(nullif(conversation_id, ''), id) AS k, arg_max(rec_id, (exported_at, rec_id)) AS rec_id FROM chatgpt_convs GROUP BY 1),
        nd AS (SELECT r.k, e.key AS id, nullif(e.value.parent, '') AS parent, e.value.message AS m
            FROM (SELECT rec_id, unnest(map_entries(mapping)) AS e FROM chatgpt_convs) c JOIN rec r USING (rec_id)),
        v AS (SELECT k, id, parent, CASE WHEN m.author."role" IN ('user', 'assistant') AND coalesce(m.metadata['is_visually_hidden_from_conversation'], 'false') <> 'true' AND (
            len(list_filter(coalesce(m.content.parts, []), lambda p: regexp_matches(coalesce(CASE WHEN p LIKE '"%' THEN p ->> '$' WHEN p LIKE '{%' THEN p ->> '$.text' END, ''), '\S'))) > 0
            OR regexp_matches(coalesce(m.content."text", '') || coalesce(m.content.user_profile, '') || coalesce(m.content.user_instructions, ''), '\S'))
            THEN m.author."role" END AS vis FROM nd),
        up AS (WITH RECURSIVE a(k, id, vis, anc) AS (
            SELECT k, id, vis, parent FROM v UNION SELECT a.k, a.id, a.vis, p.parent FROM a JOIN v p ON a.k = p.k AND a.anc = p.id) SELECT * FROM a),
        rooted AS (SELECT k, id FROM up WHERE anc IS NULL GROUP BY ALL),
        bad AS (SELECT k FROM v WHERE (k, id) NOT IN (SELECT (k, id) FROM rooted)),
        ans AS (SELECT k, anc AS id FROM up WHERE vis = 'assistant' AND anc IS NOT NULL GROUP BY ALL),
        open AS (SELECT v.k FROM v LEFT JOIN ans ON v.k = ans.k AND v.id = ans.id WHERE v.vis = 'user' AND ans.id IS NULL),
        seen AS (SELECT k FROM v WHERE vis IS NOT NULL),
        gpt AS (SELECT k FROM rec WHERE k NOT IN (SELECT k FROM seen) OR k IN (SELECT k FROM bad) OR k IN (SELECT k FROM open)),
        ln AS (SELECT DISTINCT ON (file_path, line_no) coalesce(session_id, regexp_extract(file_path, '([^/]*)\.jsonl$', 1)) AS k, line_no, uuid, leaf_uuid,
            message.content AS c, coalesce(message."role", line_type) AS r, coalesce(is_meta, false) OR coalesce(is_sidechain, false) AS aside
            FROM cc_lines ORDER BY file_path, line_no, ingested_at, line_id),
        lv AS (SELECT *, c IS NOT NULL AND NOT json_valid(c) AS invalid FROM ln),
        lw AS (SELECT *, NOT aside AND r IN ('user', 'assistant') AND NOT invalid AND regexp_matches(coalesce(CASE WHEN c LIKE '"%' THEN CASE WHEN NOT invalid THEN c ->> '$' END
            WHEN c LIKE '[%' AND NOT invalid THEN array_to_string(list_transform(CAST(c AS JSON[]), lambda b: CASE b ->> '$.type' WHEN 'text' THEN b ->> '$.text' WHEN 'thinking' THEN b ->> '$.thinking' END), '') END, ''), '\S') AS vis FROM lv),
        cc AS (SELECT k FROM lw GROUP BY k HAVING NOT bool_or(coalesce(vis, false)) OR bool_or(invalid)
            OR arg_min(r, line_no) FILTER (WHERE vis) <> 'user' OR arg_max(r, line_no) FILTER (WHERE vis) <> 'assistant'),
        lost AS (SELECT k FROM lw WHERE leaf_uuid IS NOT NULL AND (k, leaf_uuid) NOT IN (SELECT (k, uuid) FROM lw WHERE uuid IS NOT NULL))
        SELECT 'chatgpt' AS source, k AS conv_key FROM gpt UNION ALL SELECT 'claude-code', k FROM (SELECT k FROM cc UNION SELECT k FROM lost)""",
}

"""Queries of the search engine's operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import scalars
from lodestar.functions.filters import And, Compare, Filter, Glob, In, Or, parse_where
from lodestar.functions.text import chunk, plain_tokens
from lodestar.operators import listing, search, threads, upsert
from lodestar.operators.index import TextIndex, build_index
from lodestar.session import Kept
from lodestar.tables import load

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Attributes in SQL: n number (booleans as 1 and 0), t text, of a typed value.
def _sql_attr(key: str) -> tuple[str, str]:
    kind = f"json_type(attrs, '$.{key}')"
    n = f"(CASE WHEN {kind} IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(attrs ->> '$.{key}' AS DOUBLE) WHEN {kind} = 'BOOLEAN' THEN CAST(CAST(attrs ->> '$.{key}' AS BOOLEAN) AS DOUBLE) END)"
    t = f"(CASE WHEN {kind} IN ('VARCHAR', 'OBJECT', 'ARRAY') THEN attrs ->> '$.{key}' END)"
    return n, t


def _filter(name: str, f: Filter, where: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return load(spark, d, "docs").where(f.column(F.col("attrs"))).select("ns", "id")

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = f"SELECT ns, id FROM docs WHERE {where}"


_IN, _IT = _sql_attr("index")
_RN, _RT = _sql_attr("role")
_TN, _TT = _sql_attr("title")
_CN, _CT = _sql_attr("created")
_SN, _ST = _sql_attr("source")
_filter("filter_eq", Compare("=", "role", "user"), f"{_RT} = 'user'")
_filter("filter_not_eq", Compare("!=", "role", "user"), f"{_RT} <> 'user' OR {_RN} IS NOT NULL")
_filter("filter_gt", Compare(">", "index", 50), f"{_IN} > 50 OR {_IT} IS NOT NULL")
_filter("filter_gte", Compare(">=", "index", 50), f"{_IN} >= 50 OR {_IT} IS NOT NULL")
_filter("filter_lt", Compare("<", "created", "2025-06-01"), f"{_CT} < '2025-06-01' OR {_CN} IS NOT NULL")
_filter("filter_lte", Compare("<=", "index", 7), f"{_IN} <= 7")
_filter("filter_number_below_text", Compare(">", "created", 2025), f"{_CN} > 2025 OR {_CT} IS NOT NULL")
_filter("filter_in", In("source", ("chatgpt", "codex")), f"{_ST} IN ('chatgpt', 'codex')")
_filter("filter_in_empty", In("source", ()), "false")
_filter("filter_glob", Glob("title", "*[aeiou] *_[0-9]?"), f"coalesce({_TT}, CAST({_TN} AS VARCHAR)) GLOB '*[aeiou] *_[0-9]?'")
_filter("filter_and", And((Compare("=", "source", "claude"), Compare(">", "index", 10))), f"{_ST} = 'claude' AND ({_IN} > 10 OR {_IT} IS NOT NULL)")
_filter("filter_or", Or((Compare("=", "source", "codex"), Compare("=", "role", "assistant"))), f"coalesce({_ST} = 'codex', false) OR coalesce({_RT} = 'assistant', false)")
_filter("filter_empty_or", Or(), "true")
_filter("filter_nested_missing", Compare("!=", "session.part", "x"), "json_type(attrs, '$.session.part') IS NOT NULL")
_filter("where_compound", parse_where("index>5,role!=assistant,created>=2025-03-01"), f"({_IN} > 5 OR {_IT} IS NOT NULL) AND ({_RT} <> 'assistant' OR {_RN} IS NOT NULL) AND {_CT} >= '2025-03-01'")

_LISTED = "(SELECT count(*) FROM chunks c WHERE c.ns = d.ns AND c.doc_id = d.id)"


def _docs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, d, "docs"), load(spark, d, "chunks")


def _list_sql(order: str, page: str) -> str:
    return f"SELECT id, attrs AS attributes, CAST(length(text) AS INTEGER) AS chars, {_LISTED} AS chunks FROM docs d ORDER BY {_CT} {order} NULLS LAST, id {page}"


@query(_list_sql("DESC", "LIMIT 50"))
def list_newest(spark, d):
    return listing.list_documents(*_docs(spark, d))


@query(_list_sql("ASC", ""))
def list_asc_nulls_last(spark, d):
    return listing.list_documents(*_docs(spark, d), ascending=True, limit=-1)


@query(_list_sql("DESC", "LIMIT 20 OFFSET 20"))
def list_page2(spark, d):
    return listing.list_documents(*_docs(spark, d), limit=20, offset=20)


_GROUP = """WITH d AS (SELECT *, (SELECT count(*) FROM chunks c WHERE c.ns = docs.ns AND c.doc_id = docs.id) AS k FROM docs)
    SELECT attrs ->> '$.{key}' AS key, count(*) AS documents, CAST(sum(k) AS BIGINT) AS chunks, max(attrs ->> '$.created') AS created, min(attrs ->> '$.title') AS title
    FROM d WHERE attrs ->> '$.{key}' IS NOT NULL {where} GROUP BY 1 ORDER BY created {order}, key {page}"""


@query(_GROUP.format(key="session", where="", order="DESC NULLS LAST", page=""))
def groups_by_session(spark, d):
    return listing.group_documents(*_docs(spark, d), "session", extra=("title",), limit=-1)


@query(_GROUP.format(key="source", where="AND attrs ->> '$.role' = 'user'", order="DESC NULLS LAST", page=""))
def groups_by_source_filtered(spark, d):
    return listing.group_documents(*_docs(spark, d), "source", Compare("=", "role", "user"), extra=("title",), limit=-1)


@query(_GROUP.format(key="kind", where="", order="ASC NULLS FIRST", page="LIMIT 50"))
def groups_asc(spark, d):
    return listing.group_documents(*_docs(spark, d), "kind", extra=("title",), ascending=True)


@query(f"SELECT count(*) AS n FROM docs WHERE {_ST} = 'chatgpt'")
def count_filtered(spark, d):
    return listing.count_documents(load(spark, d, "docs"), Compare("=", "source", "chatgpt"))


@query("SELECT count(DISTINCT attrs ->> '$.session') AS n FROM docs")
def count_distinct_session(spark, d):
    return listing.count_groups(load(spark, d, "docs"), "session")


@query("""SELECT name, embedder_id, dims, created_at, (SELECT count(*) FROM docs WHERE ns = name) AS documents,
    (SELECT count(*) FROM chunks WHERE ns = name) AS chunks FROM ns_config ORDER BY name""")
def namespace_stats(spark, d):
    return listing.namespace_stats(load(spark, d, "ns_config"), *_docs(spark, d))


@query("SELECT ns, id, sha256(text || chr(0) || coalesce(nullif(attrs, ''), '{}')) AS hash FROM docs WHERE text IS NOT NULL")
def content_hash(spark, d):
    return upsert.hashed(load(spark, d, "docs")).where(F.col("text").isNotNull()).select("ns", "id", "hash")


@query("""SELECT action, count(*) AS n FROM (SELECT CASE WHEN sha256(text || chr(0) || coalesce(nullif(attrs, ''), '{}')) = hash THEN 'skipped' ELSE 'written' END AS action FROM docs) GROUP BY 1""")
def upsert_classify(spark, d):
    """Re-writing the stored documents: stale hashes are written anew."""
    docs = load(spark, d, "docs")
    return upsert.classify(docs, docs.select("ns", "id", "text", "attrs")).groupBy("action").agg(F.count("*").alias("n"))


@query("""SELECT ns, id, sha256(t || chr(0) || coalesce(nullif(attrs, ''), '{}')) AS hash FROM (
    SELECT ns, id, attrs, CASE WHEN attrs ->> '$.role' = 'user' THEN text || '!' ELSE text END AS t FROM docs)""")
def upsert_merge(spark, d):
    """State after users' documents were changed and written again."""
    docs = upsert.hashed(load(spark, d, "docs"))
    changed = docs.where(Compare("=", "role", "user").column(F.col("attrs"))).withColumn("text", F.concat("text", F.lit("!")))
    written = upsert.classify(docs, changed).where(F.col("action") == "written")
    return upsert.merge(docs, written.drop("action")).select("ns", "id", "hash")


@query("SELECT ns, id FROM docs WHERE id NOT IN (SELECT id FROM search_results)")
def delete_ids(spark, d):
    """State after every document ever found was deleted."""
    return upsert.delete_ids(load(spark, d, "docs"), load(spark, d, "search_results").select("id")).select("ns", "id")


@query("SELECT id, text, attrs FROM docs WHERE id = (SELECT min(id) FROM docs)")
def get_document(spark, d):
    docs = load(spark, d, "docs")
    first = docs.agg(F.min("id").alias("id"))
    return docs.join(first, "id").select("id", "text", "attrs")


@query()
def window_chunks(spark, d):
    """Documents in windows of their namespace's size."""
    docs, conf = load(spark, d, "docs"), load(spark, d, "ns_config").select(F.col("name").alias("ns"), "chunk_size", "chunk_over")
    size, over = F.coalesce("chunk_size", F.lit(0)), F.coalesce("chunk_over", F.lit(-1))  # the defaults where the namespace is not known
    docs = docs.join(conf, "ns", "left").withColumns({"chunk_size": size, "chunk_over": over})
    rows = docs.select("ns", "id", F.posexplode(chunk(F.col("text"), F.col("chunk_size"), F.col("chunk_over"))).alias("ord", "text"))
    return rows


@query(r"""SELECT d.ns, d.id, true AS within, true AS inside, true AS covered, octet_length(encode(regexp_replace(d.text, '^\s+|\s+$', '', 'g'))) > coalesce(n.chunk_size, 1000) AS several
    FROM docs d LEFT JOIN ns_config n ON d.ns = n.name WHERE regexp_matches(d.text, '\S')""")
def window_limits(spark, d):
    """Per document: whether all windows keep to the size, stand in the text, lose
    nothing but white space and overlap by no more than asked."""
    docs = load(spark, d, "docs").select("ns", "id", F.col("text").alias("whole"))
    conf = load(spark, d, "ns_config").select(F.col("name").alias("ns"), "chunk_size", "chunk_over")
    rows = window_chunks(spark, d).join(docs, ["ns", "id"]).join(conf, "ns", "left")
    size, over = F.coalesce("chunk_size", F.lit(1000)), F.coalesce("chunk_over", F.lit(100))
    letters = lambda c: F.length(F.regexp_replace(c, r"(?U)\s+", ""))
    per = rows.groupBy("ns", "id").agg(
        F.bool_and(F.octet_length("text") <= size).alias("within"), F.bool_and(F.instr("whole", F.col("text")) > 0).alias("inside"),
        F.count("*").alias("n"), F.sum(letters(F.col("text"))).alias("letters"), F.max(letters(F.col("whole"))).alias("bare"), F.max(over).alias("over"),
    )
    covered = F.col("letters").between(F.col("bare"), F.col("bare") + (F.col("n") - 1) * F.col("over"))
    return per.select("ns", "id", "within", "inside", covered.alias("covered"), (F.col("n") > 1).alias("several"))


WORDS = "parser queue flaky timeout importer"
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_TERMS = " UNION ALL ".join(f"SELECT '{t}' AS term" for t in WORDS.split())


def _bm25_sql(doc: str, chunk_id: str, table: str) -> str:
    return f"""WITH q AS ({_TERMS}), c AS (SELECT CAST({doc} AS VARCHAR) AS doc_id, {chunk_id} AS chunk_id, text, {_TOK} AS w FROM {table} WHERE text IS NOT NULL),
        s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM c),
        f AS (SELECT doc_id, chunk_id, text, len(w) AS l, term, len(list_filter(w, lambda x: x = term)) AS tf FROM c, q),
        df AS (SELECT term, count(*) AS m FROM f WHERE tf > 0 GROUP BY term),
        x AS (SELECT doc_id, chunk_id, any_value(text) AS text, -sum((CASE WHEN ln((n - m + 0.5) / (m + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - m + 0.5) / (m + 0.5)) END)
            * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avgdl))) AS bm25 FROM f JOIN df USING (term), s WHERE tf > 0 GROUP BY ALL),
        b AS (SELECT doc_id, min(bm25) AS bm25, arg_min(text, (bm25, chunk_id)) AS text FROM x GROUP BY doc_id)"""


def _documents(spark, d):
    return load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("chunk_id"), "text")


def _chunks(spark, d):
    return load(spark, d, "chunks").select("doc_id", F.col("id").alias("chunk_id"), "text", "vec", "ns")


_INDEXES: dict[tuple, TextIndex] = {}


def _index(spark, d, table: str, tokenizer: str = "plain") -> TextIndex:
    """The stored index of a table, built once per session below the shared
    checkpoint folder and removed with it."""
    key = (spark.sparkContext.applicationId, d, table, tokenizer)
    if key not in _INDEXES:
        chunks = _documents(spark, d) if table == "documents" else _chunks(spark, d)
        path = Kept(spark).folder("index")
        _INDEXES[key] = build_index(chunks.select("doc_id", "chunk_id", "text"), path, tokenizer)
    return _INDEXES[key]


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query(_bm25_sql("doc_id", "doc_id", "documents") + " SELECT doc_id, round(bm25, 6) AS bm25, CAST(row_number() OVER (ORDER BY bm25, doc_id) AS INTEGER) AS keyword_rank FROM b ORDER BY b.bm25, doc_id LIMIT 10")
def bm25_top10(spark, d):
    got = search.keyword_candidates(_documents(spark, d), WORDS, 10, index=_index(spark, d, "documents"))
    return _round(got, "bm25").select("doc_id", "bm25", "keyword_rank")


@query(_bm25_sql("doc_id", "id", "chunks") + " SELECT doc_id, round(bm25, 6) AS bm25, CAST(row_number() OVER (ORDER BY bm25, doc_id) AS INTEGER) AS keyword_rank FROM b ORDER BY b.bm25, doc_id LIMIT 100")
def bm25_doc_collapse(spark, d):
    got = search.keyword_candidates(_chunks(spark, d), WORDS, 100, index=_index(spark, d, "chunks"))
    return _round(got, "bm25").select("doc_id", "bm25", "keyword_rank")


@query(_bm25_sql("doc_id", "id", "chunks") + f" SELECT doc_id, round(bm25, 6) AS bm25 FROM b WHERE doc_id IN (SELECT id FROM docs WHERE {_RT} = 'user') ORDER BY b.bm25, doc_id LIMIT 100")
def bm25_filtered(spark, d):
    docs = load(spark, d, "docs").where(Compare("=", "role", "user").column(F.col("attrs"))).select(F.col("id").alias("doc_id"))
    got = search.keyword_candidates(_chunks(spark, d), WORDS, 100, docs, index=_index(spark, d, "chunks"))
    return _round(got, "bm25").select("doc_id", "bm25")


#: Every word whose Porter stem is that of a word of the query below.
_STEMS = {"cach": "cach(e|es|ed|ing)?", "parser": "parsers?", "import": "import(s|ed|er|ers|ing|ings)?", "twice": "twices?"}
_PORTER_SQL = (
    _bm25_sql("doc_id", "id", "chunks")
    .replace(_TERMS, " UNION ALL ".join(f"SELECT '{t}' AS term, '{p}' AS pattern" for t, p in _STEMS.items()))
    .replace("x = term", "regexp_full_match(x, pattern)")
    .replace("lower(text)", "strip_accents(lower(text))")
)


@query(_PORTER_SQL + " SELECT doc_id, round(bm25, 6) AS bm25, CAST(row_number() OVER (ORDER BY bm25, doc_id) AS INTEGER) AS keyword_rank, text AS keyword_text FROM b ORDER BY b.bm25, doc_id LIMIT 10")
def bm25_porter_top10(spark, d):
    index = _index(spark, d, "chunks", "porter")
    return _round(search.keyword_candidates(_chunks(spark, d), "cached parsers imported twice", 10, index=index), "bm25")


@query(f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM (SELECT id, {_TOK} AS w FROM chunks)) GROUP BY id, term) GROUP BY term")
def term_statistics(spark, d):
    p = _index(spark, d, "chunks").rows
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("cf"))


@query(f"SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM (SELECT {_TOK} AS w FROM chunks WHERE text IS NOT NULL)")
def corpus_statistics(spark, d):
    c = _chunks(spark, d).where(F.col("text").isNotNull()).select(F.size(plain_tokens(F.col("text"))).alias("l"))
    return c.agg(F.count("*").alias("n"), F.avg("l").alias("avgdl"))


def _query_vector(spark, d) -> list[float]:
    row = load(spark, d, "embeddings").where(F.col("vec_id") == 0).select("embedding").first()  # one query vector
    return [float(x) for x in row["embedding"]]


_DOT = "list_dot_product(CAST(vec AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[]))"
_SEM = f"""WITH s AS (SELECT doc_id, id, text, {_DOT} AS c FROM chunks WHERE len(vec) = 64), b AS (SELECT doc_id, max(c) AS c, arg_max(text, (c, -id)) AS text FROM s GROUP BY doc_id)"""


@query(_SEM + " SELECT doc_id, round(c, 6) AS cosine, CAST(row_number() OVER (ORDER BY c DESC, doc_id) AS INTEGER) AS semantic_rank FROM b ORDER BY b.c DESC, doc_id LIMIT 100")
def cosine_best_per_document(spark, d):
    got = search.semantic_candidates(_chunks(spark, d), _query_vector(spark, d))
    return _round(got, "cosine").select("doc_id", "cosine", "semantic_rank")


@query("""WITH s AS (SELECT vec_id, label, list_dot_product(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])) AS c FROM embeddings)
    SELECT vec_id, label, round(c, 6) AS cosine FROM s ORDER BY c DESC, vec_id LIMIT 10""")
def cosine_top10(spark, d):
    dot = search.cosine_udf(_query_vector(spark, d))
    rows = load(spark, d, "embeddings").select("vec_id", "label", dot("embedding").alias("cosine"))
    return _round(rows.orderBy(F.desc("cosine"), "vec_id").limit(10), "cosine")


def _rrf_sql(k: int, top: int, mode: str = "hybrid") -> str:
    kw = "SELECT doc_id, text, row_number() OVER (ORDER BY bm25, doc_id) AS r FROM b ORDER BY r LIMIT 100"
    sem = "SELECT doc_id, text, row_number() OVER (ORDER BY c DESC, doc_id) AS r FROM v ORDER BY r LIMIT 100"
    if mode == "keyword":
        sem = f"SELECT * FROM ({sem}) WHERE false"
    if mode == "semantic":
        kw = f"SELECT * FROM ({kw}) WHERE false"
    return (
        _bm25_sql("doc_id", "id", "chunks")
        + f""", s2 AS (SELECT doc_id, id, text, {_DOT} AS c FROM chunks WHERE len(vec) = 64),
        v AS (SELECT doc_id, max(c) AS c, arg_max(text, (c, -id)) AS text FROM s2 GROUP BY doc_id), kw AS ({kw}), sm AS ({sem})
        SELECT coalesce(kw.doc_id, sm.doc_id) AS id, round(coalesce(1.0 / ({k} + kw.r), 0) + coalesce(1.0 / ({k} + sm.r), 0), 6) AS score, coalesce(sm.text, kw.text) AS text,
        CAST(coalesce(kw.r, 0) AS INTEGER) AS keyword_rank, CAST(coalesce(sm.r, 0) AS INTEGER) AS semantic_rank
        FROM kw FULL JOIN sm ON kw.doc_id = sm.doc_id ORDER BY coalesce(1.0 / ({k} + kw.r), 0) + coalesce(1.0 / ({k} + sm.r), 0) DESC, id LIMIT {top}"""
    )


def _search(spark, d, **kw) -> DataFrame:
    return _round(search.search(_chunks(spark, d), WORDS, _query_vector(spark, d), index=_index(spark, d, "chunks"), **kw), "score")


@query(_rrf_sql(60, 10))
def rrf_hybrid(spark, d):
    return _search(spark, d)


@query(_rrf_sql(10, 25))
def rrf_k10(spark, d):
    return _search(spark, d, k=10, top=25)


@query(_rrf_sql(60, 10, "keyword"))
def mode_keyword(spark, d):
    return _search(spark, d, mode="keyword")


@query(_rrf_sql(60, 10, "semantic"))
def mode_semantic(spark, d):
    return _search(spark, d, mode="semantic")


def _turns(spark, d) -> DataFrame:
    """Documents as turns of their sessions, by time and id."""
    return load(spark, d, "documents").select(
        F.lit("chat").alias("source"), "session", F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("turn_id"),
        F.coalesce("role", F.lit("unknown")).alias("role"), "text", F.lit("").alias("created"),
    )


_T = "SELECT session, doc_id AS pos, coalesce(role, 'unknown') AS role, text FROM documents"
_TRIM = r"regexp_replace(text, '^[\s\x{00A0}\x{3000}\x{2000}-\x{200A}\x{0085}\x{1680}\x{2028}\x{2029}\x{202F}\x{205F}]+|[\s\x{00A0}\x{3000}\x{2000}-\x{200A}\x{0085}\x{1680}\x{2028}\x{2029}\x{202F}\x{205F}]+$', '', 'g')"


@query(f"""WITH t AS (SELECT session, pos, role, {_TRIM} AS x FROM ({_T}) WHERE {_TRIM} <> ''), r AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS n FROM t WINDOW w AS (PARTITION BY session ORDER BY pos)),
    g AS (SELECT *, sum(n) OVER (PARTITION BY session ORDER BY pos) AS run FROM r)
    SELECT session, CAST(run AS BIGINT) AS run, min(role) AS role, string_agg(x, chr(10) || chr(10) ORDER BY pos) AS text FROM g WHERE session IS NOT NULL GROUP BY session, run""")
def transcript_runs(spark, d):
    """Runs of one role with their whole text."""
    turns = _turns(spark, d).where(F.col("session").isNotNull())
    return threads.merged_runs(turns).select("session", "run", "role", "text")


@query(f"SELECT 'chat' AS source, session, arg_min({_TRIM}, pos) AS first_user FROM ({_T}) WHERE lower(role) IN ('user', 'human') AND {_TRIM} <> '' GROUP BY session")
def first_user_turn(spark, d):
    return threads.first_user_turn(_turns(spark, d))


@query("""SELECT 'chat:' || session || ':' || doc_id AS id, text, CAST(to_json({'index': doc_id, 'kind': 'message', 'role': coalesce(role, 'unknown'), 'session': session, 'source': 'chat'}) AS VARCHAR) AS attrs
    FROM documents WHERE session IS NOT NULL""")
def turn_documents(spark, d):
    return threads.turn_documents(_turns(spark, d).where(F.col("session").isNotNull())).select("id", "text", "attrs")


@query(f"""WITH c AS (SELECT session, count(*) AS messages, string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY pos) AS text FROM ({_T}) WHERE text IS NOT NULL AND session IS NOT NULL GROUP BY session)
    SELECT 'chat:' || session AS id, {_TRIM} AS text, messages, CAST(to_json({{'kind': 'conversation', 'messages': messages, 'session': session, 'source': 'chat'}}) AS VARCHAR) AS attrs FROM c""")
def conversation_documents(spark, d):
    """Every conversation as one document: its whole text and its attributes."""
    return threads.conversation_documents(_turns(spark, d).where(F.col("session").isNotNull()))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents")
def one_line(spark, d):
    return load(spark, d, "documents").select("doc_id", scalars.one_line(F.col("text")).alias("flat"))


_SHORT = "CASE WHEN length(t) > 40 THEN left(t, 39) || '…' ELSE t END"


@query(rf"SELECT doc_id, {_SHORT} AS line FROM (SELECT doc_id, trim(regexp_replace(split_part(trim(text), chr(10), 1), '\s+', ' ', 'g')) AS t FROM documents)")
def first_lines(spark, d):
    return load(spark, d, "documents").select("doc_id", scalars.first_line(F.col("text"), 40).alias("line"))


@query("SELECT doc_id, rtrim(left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '-') AS slug FROM documents")
def slugs(spark, d):
    return load(spark, d, "documents").select("doc_id", scalars.slug(F.col("text"), 60).alias("slug"))


@query(r"""SELECT doc_id, CASE WHEN t = '' OR regexp_matches(t, '[:#\[\]{}&*!|>''"%@`,?-]|^\s|\s$') THEN '"' || regexp_replace(t, '(["\\])', '\\\1', 'g') || '"' ELSE t END AS quoted
    FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)""")
def yaml_strings(spark, d):
    return load(spark, d, "documents").select("doc_id", scalars.yaml_string(F.col("text")).alias("quoted"))


@query("SELECT id, count(*) > 0 AS same FROM docs WHERE json_valid(attrs) GROUP BY id")
def canonical_attributes(spark, d):
    """Attributes written with their keys turned round and spaces between have the
    same canonical form."""
    docs = load(spark, d, "docs").where(F.try_parse_json("attrs").isNotNull())
    values = F.try_variant_get(F.try_parse_json("attrs"), "$", "map<string, variant>")
    parts = F.transform(
        F.reverse(F.map_keys(values)), lambda k: F.concat(F.lit('"'), k, F.lit('" : '), F.to_json(F.try_element_at(values, k)))
    )
    turned = F.concat(F.lit("{ "), F.array_join(parts, " , "), F.lit(" }"))
    same = scalars.canonical_json(turned) == scalars.canonical_json(F.col("attrs"))
    return docs.select("id", same.alias("same"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 39) || '…' ELSE text END AS short FROM documents")
def truncate(spark, d):
    return load(spark, d, "documents").select("doc_id", scalars.truncate(F.col("text"), 40).alias("short"))


@query(r"""WITH w AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, CASE WHEN len(string_split(t, ' ')) > 60 THEN array_to_string(string_split(t, ' ')[1:60], ' ') || '…' ELSE t END AS summary FROM w""")
def fallback_summary(spark, d):
    return load(spark, d, "documents").select("doc_id", scalars.first_words(F.col("text")).alias("summary"))


@query("""SELECT event_id, CASE WHEN x > 0 THEN strftime(to_timestamp(CAST(floor(x) AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS stamp
    FROM (SELECT event_id, (value - 50) * 1000000 AS x FROM events)""")
def epoch_time(spark, d):
    """Values under 50 stand for instants before 1970, which give no time."""
    return load(spark, d, "events").select("event_id", scalars.epoch_time((F.col("value") - 50) * 1000000).alias("stamp"))


@query(r"""SELECT line_id, CASE WHEN regexp_full_match(stamp, '\d{4}-\d\d-\d\d \d\d:\d\d:\d\d|\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)')
    THEN coalesce(strftime(date_trunc('second', TRY_CAST(stamp AS TIMESTAMPTZ) AT TIME ZONE 'UTC'), '%Y-%m-%dT%H:%M:%SZ'), stamp) ELSE stamp END AS stamp FROM cc_lines""")
def normalize_time(spark, d):
    return load(spark, d, "cc_lines").select("line_id", scalars.normalize_time(F.col("stamp")).alias("stamp"))


@query("""SELECT key, count(*) AS documents, min(v) AS least, max(v) AS greatest FROM (SELECT event_type AS key, CAST(props ->> '$.k' AS DOUBLE) AS v FROM events) GROUP BY key""")
def event_attributes(spark, d):
    """JSON attributes of events, by type."""
    rows = load(spark, d, "events").select(F.col("event_type").alias("key"), F.get_json_object("props", "$.k").cast("double").alias("v"))
    return rows.groupBy("key").agg(F.count("*").alias("documents"), F.min("v").alias("least"), F.max("v").alias("greatest"))

"""Queries of problems 7 to 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.leakage import find_leaks
from lodestar.llm.mixing import count_tokens, draw, mix_report
from lodestar.llm.near_duplicates import all_pairs, classes, near_duplicates
from lodestar.llm.sources import clean_source
from lodestar.llm.toxicity import labelled_sample, score_toxicity, train
from lodestar.session import Kept
from lodestar.tables import load

# TESTDATA.md: three consecutive words, similarity 0.6 or more
P7 = {"words": 3, "threshold": 0.6}


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return all_pairs(*near_duplicates(load(spark, d, "docs"), "id", "text", **P7))


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per document with its class and number of links."""
    return classes(*near_duplicates(load(spark, d, "docs"), "id", "text", **P7))


def p7_chunk_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same over stored chunks."""
    return classes(*near_duplicates(load(spark, d, "chunks"), "id", "text", **P7))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(
        load(spark, d, "documents"), "doc_id", "text", load(spark, d, "eval_items"), "item_id", "text", "answer"
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).where(F.col("kind") == "text").select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Items that leaked, with the number of documents that hold them."""
    return p8_leaks(spark, d).groupBy("item_id", "kind").agg(
        F.count("*").alias("n_docs"), F.max("n_words").alias("longest")
    )


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return Kept(spark).keep(count_tokens(load(spark, d, "documents"), "doc_id", "text", "source"), "tokens")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every drawn document of every mix with its number of copies."""
    return draw(_tokens(spark, d), load(spark, d, "mix_targets")).withColumnRenamed("id", "doc_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares per mix and source."""
    return mix_report(_tokens(spark, d), load(spark, d, "mix_targets"))


def p9_limits(spark: SparkSession, d: str) -> DataFrame:
    """Whether every source of every mix reached what it was to give, to within 2 %
    or one large document, and no document was repeated too often."""
    targets = load(spark, d, "mix_targets")
    caps = targets.select(F.col("mix_name").alias("m"), clean_source(F.col("source")).alias("s"), "max_repeats")
    rows = mix_report(_tokens(spark, d), targets).join(caps, (F.col("mix") == F.col("m")) & (F.col("src") == F.col("s")))
    near = F.abs(F.col("tokens") - F.col("wanted_tokens")) <= F.greatest(F.col("wanted_tokens") * 0.02, F.lit(3000))
    return rows.select("mix", "src", near.alias("near"), (F.col("most_copies") <= F.col("max_repeats")).alias("capped"))


#: At most so many reviewed documents fit the classifiers.
MAX_LABELLED = 3000


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    labelled = labelled_sample(docs, "doc_id", "text", load(spark, d, "review_labels"), MAX_LABELLED)
    return score_toxicity(docs.select("doc_id", "source", "text"), "text", train(labelled))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).drop("text", "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("flagged").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of flagged documents per source, and the mean score."""
    return (
        _scored(spark, d)
        .groupBy(clean_source(F.col("source")).alias("source"))
        .agg(
            F.count("*").alias("n_docs"),
            F.sum(F.col("flagged").cast("bigint")).alias("n_flagged"),
            F.avg(F.col("flagged").cast("double")).alias("rate"),
            F.avg("score").alias("mean_score"),
        )
    )


QUERIES = {
    f.__name__: f
    for f in (
        p7_found, p7_classes, p7_chunk_classes, p8_found, p8_leaks, p8_items, p9_mix, p9_report, p9_limits, p10_found, p10_scores, p10_rates,
    )
}

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
ORACLE = {
    "p8_found": rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
        dg AS (SELECT doc_id, hash(array_to_string(w[k:k+9], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d)),
        ig AS (SELECT item_id, hash(array_to_string(w[k:k+9], ' ')) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p8_items": rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w, {_WORDS.replace("text", "answer")} AS a FROM eval_items),
        dg AS (SELECT doc_id, k, hash(array_to_string(w[k:k+9], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM d)),
        ig AS (SELECT item_id, hash(array_to_string(w[k:k+9], ' ')) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i)),
        sizes AS (SELECT DISTINCT len(a) AS n FROM i WHERE len(a) >= 3),
        da AS (SELECT doc_id, n, k, hash(array_to_string(w[k:k+n-1], ' ')) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
        hits AS (SELECT DISTINCT doc_id, item_id, 'text' AS kind, k, 10 AS n FROM dg JOIN ig USING (g)
            UNION ALL SELECT doc_id, item_id, 'answer', k, da.n FROM da JOIN i ON da.n = len(a) AND da.g = hash(array_to_string(a, ' '))),
        cut AS (SELECT *, CASE WHEN k <= lag(k + n) OVER r THEN 0 ELSE 1 END AS new FROM hits WINDOW r AS (PARTITION BY doc_id, item_id, kind ORDER BY k)),
        runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, item_id, kind ORDER BY k) AS run FROM cut),
        found AS (SELECT doc_id, item_id, kind, max(k + n) - min(k) AS words FROM runs GROUP BY doc_id, item_id, kind, run)
        SELECT item_id, kind, count(DISTINCT doc_id) AS n_docs, CAST(max(words) AS INTEGER) AS longest FROM found GROUP BY item_id, kind""",
    "p7_found": rf"""WITH d AS (SELECT id, {_WORDS} AS w FROM docs),
        s AS (SELECT DISTINCT id, hash(array_to_string(w[k:k+2], ' ')) AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS k FROM d)),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
        SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.6 * (x.n + y.n - c)""",
}


def _classes_sql(table: str) -> str:
    return rf"""WITH RECURSIVE d AS (SELECT id, {_WORDS} AS w FROM {table}),
        s AS (SELECT DISTINCT id, hash(array_to_string(w[k:k+2], ' ')) AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS k FROM d)),
        m AS (SELECT id, min(id) OVER (PARTITION BY list_g) AS rep FROM (SELECT id, list(g ORDER BY g) AS list_g FROM s GROUP BY id)),
        h AS (SELECT s.* FROM s JOIN m USING (id) WHERE id = rep), n AS (SELECT id, count(*) AS n FROM h GROUP BY id),
        c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.6 * (x.n + y.n - c)),
        r(id, c) AS (SELECT a, a FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a),
        k AS (SELECT id, min(c) AS class_id FROM r GROUP BY id), g AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY a)
        SELECT m.id, coalesce(k.class_id, m.rep) AS class_id, coalesce(g.n_links, 0) AS n_links FROM m LEFT JOIN k ON k.id = m.rep LEFT JOIN g ON g.id = m.rep"""


ORACLE["p9_limits"] = "SELECT mix_name AS mix, source AS src, true AS near, true AS capped FROM mix_targets"
ORACLE["p7_classes"] = _classes_sql("docs")
ORACLE["p7_chunk_classes"] = _classes_sql("chunks")

"""One ranking from several differently-scaled scores (Borda count).

Every score becomes competition ranks with averaged ties within its query; an
item earns, per score, the number of items it beats (ties half), times the
score's weight. A missing score gets the mid-rank. The sum orders the items;
equal sums are ordered by identifier.

A query of at most ``whole`` rows is ranked inside one task: all its windows
share one shuffle by query. The rows of larger queries, found by a partial
aggregation, take the wide way: ranks over distinct values in value buckets
whose totals are prefix-summed, so a query that holds a third of all rows spreads
over many tasks. Both ways give the same rows.

Defined results:
* repeated (query, item) rows count once, the latest by ``latest`` (then the
  largest scores) standing for all;
* null and NaN scores are missing; infinities rank at the ends;
* a null query is a query of its own, a null item an item of its own, first
  among equals; an empty table gives an empty table;
* other columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.columns import bucket_of, running_total
from lodestar.session import Kept


@dataclass(frozen=True)
class Score:
    """A score column; ``higher`` tells whether more is better."""

    column: str
    higher: bool = True
    weight: float = 1.0


def borda_rank(
    df: DataFrame, query: str, item: str, scores: list[Score], latest: str | None = None, whole: int = 100_000
) -> DataFrame:
    """Columns ``query, item, points, position`` and, per score,
    ``rank_<column>`` (competition rank, 0 where missing)."""
    picked = F.struct(*[F.col(s.column).cast("double").alias(f"s{i}") for i, s in enumerate(scores)])
    by = F.struct(*([F.col(latest)] if latest else []), picked)
    rows = df.select(F.col(query).alias("q"), F.col(item).alias("i"), picked.alias("s"), by.alias("by"))
    big = rows.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") > whole)
    big = Kept(df.sparkSession).keep(big.select(F.col("q").alias("bq")), "big-queries")
    if big.isEmpty():
        out = _ranked_whole(rows, scores)
    else:
        same = F.col("q").eqNullSafe(F.col("bq"))
        out = _ranked_whole(rows.join(big, same, "left_anti"), scores).unionByName(
            _ranked_wide(rows.join(big, same, "left_semi"), scores)
        )
    return out.withColumnsRenamed({"q": query, "i": item})


def _ascending(s: Score, k: int) -> Column:
    """The best first, null where missing; -0.0 and 0.0 are one value."""
    v = F.col(f"s.s{k}")
    return F.when(~F.isnan(v), v * (-1.0 if s.higher else 1.0) + 0.0)


def _ranked_whole(rows: DataFrame, scores: list[Score]) -> DataFrame:
    """Windows over whole queries: one shuffle."""
    rows = rows.repartition("q")
    latest = Window.partitionBy("q", "i").orderBy(F.col("by").desc())
    rows = rows.withColumn("o", F.row_number().over(latest)).where(F.col("o") == 1)
    rows = rows.select("q", "i", *[_ascending(s, k).alias(f"v{k}") for k, s in enumerate(scores)])
    rows = rows.withColumn("size", F.count("*").over(Window.partitionBy("q")))
    points = F.lit(0.0)
    for k, s in enumerate(scores):
        v = F.col(f"v{k}")
        rows = rows.withColumns(
            {
                f"r{k}": F.when(v.isNotNull(), F.rank().over(Window.partitionBy("q").orderBy(v.asc_nulls_last()))),
                f"t{k}": F.count("*").over(Window.partitionBy("q", f"v{k}")),
            }
        )
        average = F.coalesce(F.col(f"r{k}") + (F.col(f"t{k}") - 1) / 2, (F.col("size") + 1) / 2)
        points = points + float(s.weight) * (F.col("size") - average)
    rows = rows.withColumn("points", F.round(points, 9))
    order = Window.partitionBy("q").orderBy(F.col("points").desc(), F.col("i").asc_nulls_first())
    return rows.select(
        "q", "i", "points", F.row_number().over(order).alias("position"),
        *[F.coalesce(f"r{k}", F.lit(0)).cast("int").alias(f"rank_{s.column}") for k, s in enumerate(scores)],
    )


def _ranked_wide(rows: DataFrame, scores: list[Score]) -> DataFrame:
    """Value buckets and prefix sums: no task sees a whole query."""
    rows = rows.groupBy("q", "i").agg(F.max_by("s", "by").alias("s"))
    key = F.array(*[F.struct(F.lit(k).alias("m"), _ascending(s, k).alias("v")) for k, s in enumerate(scores)])
    long = rows.select("q", "i", F.explode(key).alias("e")).select("q", "i", "e.m", "e.v")
    finite = F.greatest(F.least(F.col("v"), F.lit(1e300)), F.lit(-1e300))
    values = (
        long.where(F.col("v").isNotNull())
        .groupBy("q", "m", "v")
        .agg(F.count("*").alias("n"))
        .withColumn("b", bucket_of(finite))
    )
    values = running_total(values, ["q", "m"], "b", [F.col("v")], F.col("n"), "before").select(
        F.col("q").alias("vq"), F.col("m").alias("vm"), F.col("v").alias("vv"), "n", "before"
    )
    sizes = rows.groupBy(F.col("q").alias("nq")).agg(F.count("*").alias("size"))
    long = long.join(
        values,
        F.col("q").eqNullSafe(F.col("vq")) & (F.col("m") == F.col("vm")) & (F.col("v") == F.col("vv")),
        "left",
    ).join(sizes, F.col("q").eqNullSafe(F.col("nq")))
    mid = (F.col("size") + 1) / 2
    average = F.coalesce(F.col("before") + (F.col("n") + 1) / 2, mid)
    weight = F.element_at(F.array(*[F.lit(float(s.weight)) for s in scores]), F.col("m") + 1)
    ranked = long.groupBy("q", "i").agg(
        F.sum(weight * (F.col("size") - average)).alias("points"),
        *[
            F.max(F.when(F.col("m") == k, F.coalesce(F.col("before") + 1, F.lit(0)))).cast("int").alias(f"rank_{s.column}")
            for k, s in enumerate(scores)
        ],
    )
    # Weighted sums of halves: rounding makes equal sums equal in any order of addition.
    ranked = ranked.withColumn("points", F.round("points", 9))
    ranked = ranked.withColumn("b", bucket_of(-F.col("points")))
    order = [F.col("points").desc(), F.col("i").asc_nulls_first()]
    out = running_total(ranked, ["q"], "b", order, F.lit(1), "before")
    return out.select(
        "q",
        "i",
        "points",
        (F.col("before") + 1).cast("int").alias("position"),
        *[f"rank_{s.column}" for s in scores],
    )

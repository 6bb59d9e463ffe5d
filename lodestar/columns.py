"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shield(df: DataFrame, reserved: Iterable[str]) -> DataFrame:
    """Rename input columns that clash with an operator's own output names.

    A clashing column ``x`` becomes ``x_in`` (then ``x_in_in`` ...). Names are
    compared without case, as Spark resolves them.
    """
    taken = {c.lower() for c in df.columns} | {r.lower() for r in reserved}
    names = {r.lower() for r in reserved}
    out = []
    for c in df.columns:
        n = c
        if c.lower() in names:
            n = f"{c}_in"
            while n.lower() in taken:
                n += "_in"
            taken.add(n.lower())
        out.append(n)
    return df.toDF(*out)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that the optimizer may neither repeat nor merge: a
    generator of one row stands between them and whatever uses them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def bucket_of(value: Column, per_octave: int = 64) -> Column:
    """A monotone integer bucket of a finite double: equal or larger values
    never get a smaller bucket, whatever the scale of the data."""
    v = value.cast("double")
    return (F.signum(v) * F.floor(F.log2(F.lit(1.0) + F.abs(v)) * per_octave)).cast("bigint")


def running_total(
    df: DataFrame, keys: list[str], bucket: str, order: list[Column], amount: Column, out: str, nulls: bool = True
) -> DataFrame:
    """Sum of ``amount`` over the rows *before* each row within ``keys``."""
    return running(df, keys, bucket, order, {out: amount}, nulls=nulls)


def running(
    df: DataFrame, keys: list[str], bucket: str, order: list[Column], amounts: dict[str, Column], peak: bool = False, nulls: bool = True
) -> DataFrame:
    """Sums over the rows before each row within ``keys``; with ``peak`` the
    greatest value up to and including each row instead. Keys that are never null
    (``nulls`` false) save a shuffle.

    Two levels, so that a hot key never lands in one task: values per
    (keys, bucket) are carried over the buckets, then each bucket is ordered on its
    own. ``bucket`` must not decrease along ``order``.
    """
    fold = F.max if peak else F.sum
    per = df.groupBy(*keys, bucket).agg(*[fold(a).alias(f"__amt{i}") for i, a in enumerate(amounts.values())])
    upto = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(bucket).alias("__b"),
        *[fold(f"__amt{i}").over(upto).alias(f"__base{i}") for i in range(len(amounts))],
    )
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if peak else -1)
    out = {}
    for i, (name, amount) in enumerate(amounts.items()):
        base, here = F.col(f"__base{i}"), fold(amount).over(inner)
        out[name] = F.greatest(base, here) if peak else F.coalesce(base, F.lit(0)) + F.coalesce(here, F.lit(0))
    helpers = ["__b", *[f"__base{i}" for i in range(len(amounts))], *[f"__k{i}" for i in range(len(keys))]]
    return df.join(per, _same_bucket(keys, bucket, nulls)).withColumns(out).drop(*helpers)


def _same_bucket(keys: list[str], bucket: str, nulls: bool) -> Column:
    pairs = [("__b", bucket), *[(f"__k{i}", k) for i, k in enumerate(keys)]]
    return reduce(and_, [F.col(x).eqNullSafe(F.col(y)) if nulls else F.col(x) == F.col(y) for x, y in pairs])


def before(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: list[str], out: str, nulls: bool = True) -> DataFrame:
    """Adds ``out``: a struct of the columns ``value`` of the row before each row
    within ``keys`` (null for the first), in the same two levels as ``running``."""
    last = F.max_by(F.struct(*value), F.struct(*order)).alias("__last")
    per = df.groupBy(*keys, bucket).agg(last)
    per = per.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col(bucket).alias("__b"),
        F.lag("__last").over(Window.partitionBy(*keys).orderBy(bucket)).alias("__base"),
    )
    here = F.lag(F.struct(*value)).over(Window.partitionBy(*keys, bucket).orderBy(*order))
    rows = df.join(per, _same_bucket(keys, bucket, nulls)).withColumn(out, F.coalesce(here, F.col("__base")))
    return rows.drop("__b", "__base", *[f"__k{i}" for i in range(len(keys))])


def has_text(c: Column) -> Column:
    """True where the text holds something but white space (Unicode)."""
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def trim_unicode(c: Column) -> Column:
    """Text without leading and trailing Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")

"""Mixed timestamp notations to one UTC instant in milliseconds.

Every value is parsed under each reading that fits it, with built-in column
expressions only: a numeric day and month day first or month first, a plain number
as seconds, milliseconds or microseconds, other notations in one way. A source is
a mixture of readings. Expectation-maximisation finds their shares: a value
contributes its likelihood under each valid reading (an instant before 1990, after
2100 or after its arrival is unlikely), the sufficient statistics are the counts of
likelihood patterns per source (one partial aggregation), and the posterior picks
the reading or marks it unresolved.

Where an order of day and month is agreed beforehand (``conventions``), the mixture
gives the contrary reading no share, whatever the counts: its posterior chooses the
agreed reading of a value that fits both and leaves none for one that fits only the
contrary. What data then decide is the rest. Rows are parsed once and kept in the
shared folder between counting and choosing.

Defined results:
* null, blank, zero, negative and unreadable stamps: ``utc_ms`` null,
  ``reading`` null;
* impossible dates or times (30 February, hour 24, second 60): unreadable;
* numbers that no reading puts before the year 10000: unreadable;
* dates that fit only a reading contrary to the agreed one: unreadable;
* no zone: wall clock of ``tz`` (UTC where ``tz`` is null or unknown); a wall
  time that occurs twice is the first, one that is skipped counts with the
  offset before the change;
* finer digits than milliseconds are cut off;
* repeated rows stay, each with the same result; an empty table gives an empty
  table; input columns named like an output column are renamed ``*_in``.
"""

from __future__ import annotations

import zoneinfo
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.columns import once, shield
from lodestar.session import Kept

OUT = ("utc_ms", "reading", "posterior", "ambiguous", "canonical")

#: Hours east of UTC that zone letters stand for. Letters with
#: several meanings list all; the device's own offset chooses the nearest.
ZONE_LETTERS = {
    "ACDT": (10.5,), "ACST": (9.5,), "ADT": (-3,), "AEDT": (11,), "AEST": (10,), "AKDT": (-8,),
    "AKST": (-9,), "AST": (-4, 3), "AWST": (8,), "BRST": (-2,), "BRT": (-3,), "BST": (1, 6),
    "CAT": (2,), "CDT": (-5, -4), "CEST": (2,), "CET": (1,), "CST": (-6, 8, -5), "EAT": (3,),
    "EDT": (-4, 11), "EEST": (3,), "EET": (2,), "EST": (-5, 10), "GMT": (0,), "HKT": (8,),
    "HST": (-10,), "ICT": (7,), "IDT": (3,), "IST": (5.5, 2, 1), "JST": (9,), "KST": (9,),
    "MDT": (-6,), "MSK": (3,), "MST": (-7, 8), "NDT": (-2.5,), "NPT": (5.75,), "NST": (-3.5,),
    "NZDT": (13,), "NZST": (12,), "PDT": (-7,), "PKT": (5,), "PST": (-8, 8), "SAST": (2,),
    "SGT": (8,), "UT": (0,), "UTC": (0,), "WAT": (1,), "WEST": (1,), "WET": (0,), "WIB": (7,),
    "Z": (0,),
}

_ZONE = r"(Z|[+-]\d{2}(?::?\d{2})?|(?:UTC|GMT)[+-]\d{2}:?\d{2}|[A-Za-z]{2,5})?"
_TIME = r"(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?"
_NAME = r"([A-Za-z]{3,9})\.?"

#: notation -> (pattern, replacement giving year|month|day|h|m|s|frac|ampm|zone)
SHAPES = {
    "iso": (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[Tt]|\s+)" + _TIME + r"\s*" + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    "basic": (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?" + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    "dotted": (r"^(\d{1,2})\.(\d{1,2})\.(\d{4}),?\s+" + _TIME + r"(?:\s*([AaPp])\.?[Mm]\.?)?\s*" + _ZONE + "$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    "slashed": (r"^(\d{1,2})/(\d{1,2})/(\d{4}),?\s+" + _TIME + r"(?:\s*([AaPp])\.?[Mm]\.?)?\s*" + _ZONE + "$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    "named": ("^" + _NAME + r"\s+(\d{1,2}),?\s+(\d{4}),?\s+" + _TIME + r"(?:\s*([AaPp])\.?[Mm]\.?)?\s*" + _ZONE + "$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    "http": (r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[\s-]" + _NAME + r"[\s-](\d{4})\s+" + _TIME + r"\s*" + _ZONE + "$", "$3|$2|$1|$4|$5|$6|$7||$8"),
}

NUMBER = r"^\d{1,25}(?:\.\d+)?(?:[eE]\+?\d{1,2})?$"
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"

#: The readings of a shape, in the order of their columns; other shapes have one.
READINGS = {
    "dotted": ("dotted-dmy", "dotted-mdy"), "slashed": ("slashed-dmy", "slashed-mdy"),
    "number": ("number-s", "number-ms", "number-us"),
}
#: Conventions that may be agreed: of an order of day and month, or that a
#: number's unit follows from its magnitude (under 10^11 seconds, under 10^14
#: milliseconds, else microseconds).
CONVENTIONS = {"dotted": "dmy", "slashed": "mdy", "number": "magnitude"}
#: The last instant that counts as a date: the end of the year 9999.
_LAST = 253_402_300_799_999

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _wall(year: Column, month: Column, day: Column, p: Column) -> Column:
    """The wall clock as a timestamp read in UTC; null where impossible."""
    half = F.lower(p[7])
    hour = _int(p[3])
    hour = (
        F.when(half == "", hour)
        .when(~hour.between(1, 12), F.lit(None).cast("int"))
        .when(half == "a", hour % 12)
        .otherwise(hour % 12 + 12)
    )
    second = _int(p[5])
    second = F.when(second < 60, second)
    return F.try_make_timestamp(
        year, month, day, hour, _int(p[4]), second.cast("decimal(16,6)"), F.lit("UTC")
    )


def known_zone(column: str) -> Column:
    """The zone name, or UTC where it is null or no IANA zone."""
    names = ", ".join(f"'{z}'" for z in sorted(zoneinfo.available_timezones()))
    return F.expr(f"CASE WHEN {column} IN ({names}) THEN {column} ELSE 'UTC' END")


def _instant(wall: Column, p: Column, tz: Column) -> Column:
    """Milliseconds since 1970 of a wall clock with its zone part."""
    wall_ms = F.unix_millis(wall)
    local_ms = F.unix_millis(F.to_utc_timestamp(wall, tz))
    zone = F.regexp_replace(F.upper(p[8]), r"^(?:UTC|GMT)(?=[+-])", "")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, r"[^0-9]", "")
    shift = sign * (
        F.coalesce(_int(F.substring(digits, 1, 2)), F.lit(0)) * 60
        + F.coalesce(_int(F.substring(digits, 3, 2)), F.lit(0))
    )
    letters = F.expr(
        "map(" + ", ".join(f"'{k}', array({', '.join(str(int(h * 60)) for h in v)})" for k, v in ZONE_LETTERS.items()) + ")"
    )
    own = ((wall_ms - local_ms) / 60000).cast("int")
    nearest = F.array_min(
        F.transform(
            F.try_element_at(letters, zone),
            lambda m: F.struct(F.abs(m - own).alias("far"), m.alias("minutes")),
        )
    )["minutes"]
    utc = (
        F.when(zone == "", local_ms)
        .when(zone.rlike("^[+-]"), wall_ms - shift.cast("bigint") * 60000)
        .otherwise(F.coalesce(wall_ms - nearest.cast("bigint") * 60000, local_ms))
    )
    frac = _int(F.substring(F.concat(p[6], F.lit("000")), 1, 3))
    return utc + frac


def readings(stamp: Column) -> dict[str, Column]:
    """Column expressions of one stamp: its trimmed ``text``, its ``shape``
    and, given that in ``__shape``, its ``parts``."""
    t = F.regexp_replace(stamp, r"(?U)^\s+|\s+\z", "")
    shape = reduce(
        lambda acc, kv: acc.when(t.rlike(kv[1][0]), F.lit(kv[0])),
        list(SHAPES.items())[1:],
        F.when(t.rlike(SHAPES["iso"][0]), F.lit("iso")),
    ).when(t.rlike(NUMBER), F.lit("number"))
    parts = reduce(
        lambda acc, kv: acc.when(F.col("__shape") == kv[0], F.regexp_replace(t, *kv[1])),
        list(SHAPES.items())[1:],
        F.when(F.col("__shape") == "iso", F.regexp_replace(t, *SHAPES["iso"])),
    )
    return {"text": t, "shape": shape, "parts": F.split(parts, r"\|")}


def parse_readings(df: DataFrame, stamp: str, tz: str | None) -> DataFrame:
    """Adds ``__shape``, its readings ``__r0``, ``__r1``, ``__r2`` (milliseconds,
    null: not valid) and ``__unit``, the reading that a number's magnitude says."""
    r = readings(F.col(stamp))
    df = df.withColumn("__tz", F.col(tz) if tz else F.lit(None).cast("string"))
    df = once(df, {"__t": r["text"], "__zone": known_zone("__tz"), "__shape": r["shape"]}).drop("__tz")
    df = once(df, {"__p": r["parts"]})
    p, name = F.col("__p"), F.lower(F.substring(F.col("__p")[1], 1, 3))
    found = F.instr(F.lit(_MONTHS), name)
    by_name = F.when((found > 0) & (found % 3 == 1), ((found + 2) / 3).cast("int"))
    two = F.col("__shape").isin("dotted", "slashed")
    named = F.col("__shape").isin("named", "http")
    one, other = _int(p[1]), _int(p[2])
    walls = {
        "__w0": _wall(_int(p[0]), F.when(two, other).when(named, by_name).otherwise(one), F.when(two, one).otherwise(other), p),
        "__w1": F.when(two, _wall(_int(p[0]), one, other, p)),
        "__n": F.when(F.col("__shape") == "number", F.col("__t").try_cast("decimal(38,9)")),
    }
    df = once(df, walls)
    n = F.when(F.col("__n") > 0, F.col("__n"))
    last = F.lit(_LAST)
    as_ms = [
        F.when(n < last / 1000, F.floor(n * 1000)), F.when(n <= last, F.floor(n)), F.when(n < F.lit(10**17), F.floor(n / 1000)),
    ]
    unit = F.when(n < F.lit(10**11), 0).when(n < F.lit(10**14), 1).when(n < F.lit(10**17), 2)
    df = once(
        df,
        {
            "__r0": F.coalesce(as_ms[0].cast("bigint"), _instant(F.col("__w0"), p, F.col("__zone"))),
            "__r1": F.coalesce(as_ms[1].cast("bigint"), F.when(two, _instant(F.col("__w1"), p, F.col("__zone")))),
            "__r2": as_ms[2].cast("bigint"),
            "__unit": unit,
        },
    )
    return df.drop("__t", "__zone", "__p", "__w0", "__w1", "__n")


def instant_ms(df: DataFrame, stamp: str, tz: str | None, out: str) -> DataFrame:
    """Adds ``out``: the instant under the fixed conventions (dotted dates day
    first, slashed dates month first, numbers by magnitude), without the mixture."""
    agreed = F.when(F.col("__shape") == "slashed", 1).otherwise(F.coalesce("__unit", F.lit(0)))
    ms = F.get(F.array("__r0", "__r1", "__r2"), agreed)
    return parse_readings(df, stamp, tz).withColumn(out, ms).drop("__shape", "__r0", "__r1", "__r2", "__unit")


#: Likelihoods by level: not valid, unlikely, plain.
_LEVELS = {"0": 0.0, "1": 1e-3, "2": 1.0}


def fit_mixture(patterns: pd.DataFrame, rounds: int = 50, barred: tuple[str, ...] = ()) -> pd.DataFrame:
    """EM over the readings of one source. ``patterns`` has a row per likelihood
    pattern ``sig`` (shape and the levels of its readings) with its count ``n``;
    added are the posteriors ``p0, p1, p2`` of the shape's readings. Shares have one
    pseudo-count per reading; those in ``barred`` have none. A pattern that only
    they explain has posteriors of zero."""
    part = patterns["sig"].str.split(":", expand=True)
    names: dict[str, int] = {}
    at = np.full((len(part), 3), -1)
    lik = np.zeros((len(part), 3))
    for row, (shape, *levels) in enumerate(part.itertuples(index=False)):
        for k, reading in enumerate(READINGS.get(shape, (shape,))):
            at[row, k] = names.setdefault(reading, len(names))
            lik[row, k] = _LEVELS[levels[k]]
    n = patterns["n"].to_numpy(float)[:, None]
    free = np.array([name not in barred for name in names], float)
    theta = free / max(free.sum(), 1.0)
    for _ in range(rounds):
        post = lik * theta[at]
        total = post.sum(1, keepdims=True)
        post = np.divide(post, total, out=np.zeros_like(post), where=total > 0)
        new = free + np.bincount(at[at >= 0], (post * n)[at >= 0], len(names))
        new /= max(new.sum(), 1.0)
        done = np.abs(new - theta).max() < 1e-12
        theta = new
        if done:
            break
    return patterns.assign(p0=post[:, 0], p1=post[:, 1], p2=post[:, 2])


def normalize_timestamps(
    df: DataFrame,
    stamp: str,
    tz: str | None = None,
    source: str | None = None,
    conventions: dict[str, str] | None = None,
    near_ms: str | None = None,
    sure: float = 0.9,
    rounds: int = 50,
) -> DataFrame:
    """Adds ``utc_ms, reading, posterior, ambiguous, canonical`` to ``df``.

    ``source`` names the column whose values share a mixture of readings (all
    rows are one source without it). ``conventions`` agrees on readings by shape
    (see ``CONVENTIONS``; of dates, the contrary reading then has no share); ``near_ms`` is an optional column with a reference
    instant (arrival time): a reading after it, by more than a day, is 1000
    times less likely. ``posterior`` below ``sure`` with readings that give
    different instants marks a row ``ambiguous``; it keeps its likeliest reading.
    """
    agreed = conventions or {}
    df = shield(df, OUT) if stamp not in OUT else df.withColumnRenamed(stamp, f"{stamp}_in")
    stamp = stamp if stamp not in OUT else f"{stamp}_in"
    df = parse_readings(df, stamp, tz)
    day = 86_400_000
    values = [F.col("__r0"), F.col("__r1"), F.col("__r2")]
    # readings without a share, and the place of the one that a number's magnitude says
    barred: tuple[str, ...] = ()
    place = F.lit(None).cast("int")
    for shape, order in agreed.items():
        if order == "magnitude":
            place = F.when(F.col("__shape") == shape, F.col("__unit")).otherwise(place)
        else:
            barred += (READINGS[shape][1 - ("dmy", "mdy").index(order)],)
    place = F.when(F.get(F.array(*values), place).isNotNull(), place)

    def level(k: int) -> Column:
        ms = values[k]
        plain = ms.between(631_152_000_000, 4_102_444_800_000)
        if near_ms:
            plain = plain & (F.col(near_ms).isNull() | (ms <= F.col(near_ms) + day))
        return F.when(ms.isNull() | (place != k), 0).when(plain, 2).otherwise(1).cast("int")

    some = F.coalesce(*values).isNotNull()
    sig = F.when(some, F.concat_ws(":", "__shape", *[level(k) for k in range(3)]))
    src = F.coalesce(F.col(source).cast("string"), F.lit("")) if source else F.lit("")
    df = df.withColumns({"__src": src, "__sig": sig}).drop("__unit")
    df = Kept(df.sparkSession).keep(df, "stamps")
    counts = df.where(F.col("__sig").isNotNull()).groupBy("__src", "__sig").agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        done = fit_mixture(pdf.rename(columns={"__sig": "sig"}), rounds, barred)
        done.columns = [{"__src": "__s", "sig": "__g"}.get(c, f"__{c}") for c in done.columns]
        return done[["__s", "__g", "__p0", "__p1", "__p2"]]

    posts = counts.groupBy("__src").applyInPandas(fit, "__s string, __g string, __p0 double, __p1 double, __p2 double")
    df = df.join(posts, (F.col("__src") == F.col("__s")) & (F.col("__sig") == F.col("__g")), "left")
    best = F.greatest("__p0", "__p1", "__p2")
    # of equal posteriors the first reading; none where no reading has a share
    at = F.when(best > 0, F.when(F.col("__p0") == best, 0).when(F.col("__p1") == best, 1).when(F.col("__p2") == best, 2))
    ms = F.get(F.array(*values), at)
    names = F.expr("map(" + ", ".join(f"'{k}', array({', '.join(repr(x) for x in v)})" for k, v in READINGS.items()) + ")")
    reading = F.coalesce(F.get(F.try_element_at(names, F.col("__shape")), at), F.col("__shape"))
    other = reduce(or_, [(F.col(f"__p{k}") > 0) & values[k].isNotNull() & (values[k] != ms) for k in range(3)])
    return df.withColumns(
        {
            "utc_ms": ms,
            "reading": F.when(ms.isNotNull(), reading),
            "posterior": F.when(ms.isNotNull(), best),
            "ambiguous": F.coalesce(other & (best < sure), F.lit(False)),
            "canonical": F.coalesce(ms.isNotNull() & F.col(stamp).rlike(CANONICAL), F.lit(False)),
        }
    ).drop("__shape", "__r0", "__r1", "__r2", "__src", "__sig", "__s", "__g", "__p0", "__p1", "__p2")

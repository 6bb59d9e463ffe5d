"""Timestamps against an independent reading with zoneinfo."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import functions as F

from lodestar.operators.instants import CONVENTIONS, fit_mixture, normalize_timestamps

UTC = dt.timezone.utc
ZONES = ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Sydney", "America/Sao_Paulo", "UTC"]


def _ms(t):
    return (t - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(milliseconds=1)


def test_many_notations_round_trip(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(600):
        t = dt.datetime(2025, 1, 1, tzinfo=UTC) + dt.timedelta(milliseconds=rng.randrange(60_000_000_000))
        zone = rng.choice(ZONES)
        wall = t.astimezone(ZoneInfo(zone))
        if wall.fold:
            continue  # the second of two equal wall times cannot be written without zone
        sec = t.replace(microsecond=0)
        h12 = wall.strftime("%I").lstrip("0")
        kind = k % 11
        text, exact = [
            (wall.strftime("%Y-%m-%dT%H:%M:%S.") + f"{wall.microsecond // 1000:03d}", t),
            (wall.strftime("%Y-%m-%d %H:%M:%S"), sec),
            (wall.isoformat(timespec="milliseconds"), t),
            (wall.strftime("%d.%m.%Y %H:%M:%S"), sec),
            (wall.strftime("%m/%d/%Y ") + h12 + wall.strftime(":%M:%S %p"), sec),
            (wall.strftime("%b ") + str(wall.day) + wall.strftime(", %Y ") + h12 + wall.strftime(":%M:%S %p"), sec),
            (t.strftime("%a, %d %b %Y %H:%M:%S GMT"), sec),
            (t.strftime("%Y%m%dT%H%M%SZ"), sec),
            (str(_ms(t)), t),
            (f"{_ms(t) // 1000}.{_ms(t) % 1000:03d}999", t),
            (str(_ms(t) * 1000 + 999), t),
        ][kind]
        rows.append((k, text, zone))
        want[k] = _ms(exact)
    df = spark.createDataFrame(rows, "k int, stamp string, tz string")
    got = {r["k"]: r["utc_ms"] for r in normalize_timestamps(df, "stamp", "tz", conventions=CONVENTIONS).collect()}
    assert got == want


def test_edges(spark):
    rows = [
        ("2026-03-29 02:30:00", "Europe/Berlin", 1774747800000),  # skipped
        ("2026-10-25 02:30:00", "Europe/Berlin", 1792888200000),  # twice: the first
        ("2025-07-01 00:00:00 EST", "America/New_York", 1751346000000),
        ("2025-01-10 00:16:10 CST", "Asia/Shanghai", 1736439370000),
        ("2025-01-10 00:16:10 CST", "America/Chicago", 1736489770000),
        ("2025-01-01T01:00:00+05:45", None, 1735672500000),
        ("2025-01-01 01:00:00", "No/Such", 1735693200000),
        ("  1735690013952 ", None, 1735690013952),
        ("0", None, None), ("-5", None, None), ("0.0", None, None), ("n/a", None, None), ("", None, None),
        ("2025-02-30 00:00:00", None, None), ("2025-01-01 24:00:00", None, None), ("2025-01-01 10:00:60", None, None),
        ("0000-00-00 00:00:00", None, None), ("9" * 4000, None, None), (None, "Europe/Berlin", None),
    ]
    df = spark.createDataFrame([(i, s, z) for i, (s, z, _) in enumerate(rows)], "i int, stamp string, tz string")
    got = {r["i"]: r["utc_ms"] for r in normalize_timestamps(df, "stamp", "tz").collect()}
    assert [got[i] for i in range(len(rows))] == [w for _, _, w in rows]


def test_mixture_decides_the_order_of_day_and_month(spark):
    us = [("us", f"{m:02d}/{d:02d}/2025 10:00:00") for m in range(1, 13) for d in (3, 20)]
    eu = [("eu", f"{d:02d}/{m:02d}/2025 10:00:00") for m in range(1, 13) for d in (4, 25)]
    odd = [("odd", "05/06/2025 10:00:00")]
    df = spark.createDataFrame(us + eu + odd, "src string, stamp string")
    got = normalize_timestamps(df, "stamp", source="src").collect()
    assert {r["reading"] for r in got if r["src"] == "us"} == {"slashed-mdy"}
    assert {r["reading"] for r in got if r["src"] == "eu"} == {"slashed-dmy"}
    assert not any(r["ambiguous"] for r in got if r["src"] != "odd")
    assert [r["ambiguous"] for r in got if r["src"] == "odd"] == [True]


def test_a_convention_holds_whatever_the_counts(spark):
    """The agreed reading is 26 days after ``near``, the other one four before."""
    near = _ms(dt.datetime(2025, 5, 10, tzinfo=UTC))
    few = spark.createDataFrame([("few", "05.06.2025 10:00:00", near)] * 2, "src string, stamp string, near long")
    hot = spark.range(20_000).select(F.lit("hot").alias("src"), F.lit("05.06.2025 10:00:00").alias("stamp"), F.lit(near).alias("near"))
    got = normalize_timestamps(few.unionByName(hot), "stamp", source="src", conventions=CONVENTIONS, near_ms="near")
    assert {(r["src"], r["reading"]) for r in got.select("src", "reading").distinct().collect()} == {("few", "dotted-dmy"), ("hot", "dotted-dmy")}


def test_clashing_columns_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([("a", "1735690862", 7), ("a", "1735690862", 7)], "reading string, stamp string, UTC_MS int")
    got = normalize_timestamps(df, "stamp").collect()
    assert len(got) == 2 and {r["utc_ms"] for r in got} == {1735690862000}
    assert {r["UTC_MS_in"] for r in got} == {7} and {r["reading_in"] for r in got} == {"a"}
    assert normalize_timestamps(df.limit(0), "stamp").count() == 0


def test_mixture_decides_the_unit_of_numbers(spark):
    """Small numbers that fit as seconds and as milliseconds go with their source."""
    day = 86_400_000
    s = [("s", str(1_700_000_000 + k)) for k in range(40)] + [("s", "2600000000")]
    ms = [("ms", str(1_700_000_000_000 + k)) for k in range(40)] + [("ms", "700000000000")]
    us = [("us", str((1_700_000_000_000 + k) * 1000)) for k in range(40)]
    near = 2_600_000_000_000 - 2 * day  # arrival before the last value of the first source
    df = spark.createDataFrame([(a, b, near) for a, b in s + ms + us], "src string, stamp string, near long")
    got = normalize_timestamps(df, "stamp", source="src", near_ms="near").collect()
    assert {(r["src"], r["reading"]) for r in got} == {(x, f"number-{x}") for x in ("s", "ms", "us")}
    assert {r["reading"] for r in normalize_timestamps(df.limit(0).unionByName(df.where("stamp = '700000000000'")), "stamp", conventions=CONVENTIONS).collect()} == {"number-ms"}


def test_shares_follow_the_data():
    """EM against the closed form of a mixture that two kinds of values decide."""
    p = pd.DataFrame({"sig": ["slashed:2:2:0", "slashed:0:2:0", "slashed:2:0:0", "iso:2:0:0"], "n": [100, 90, 10, 500]})
    got = fit_mixture(p, 2000)
    assert abs(got["p1"][0] - 0.9) < 0.01 and got["p0"][3] == 1 and got["p1"][1] == 1 and got["p0"][2] == 1


def test_an_agreed_order_is_the_mixtures_doing(spark):
    """Every valid reading reaches the mixture; its posterior chooses, and leaves no
    instant to a date that fits only the contrary order."""
    p = pd.DataFrame({"sig": ["slashed:2:2:0", "slashed:2:1:0", "slashed:2:0:0", "iso:2:0:0"], "n": [10, 5, 10_000, 5]})
    got = fit_mixture(p, barred=("slashed-dmy",))
    assert got[["p0", "p1"]].to_numpy().tolist() == [[0, 1], [0, 1], [0, 0], [1, 0]]
    free = fit_mixture(p)
    assert (free["p0"] > 0.9).all()
    only = fit_mixture(p[2:3], barred=("slashed-dmy",))
    assert only[["p0", "p1", "p2"]].to_numpy().tolist() == [[0, 0, 0]]
    rows = [("05/06/2025 10:00:00", "slashed-mdy"), ("25/06/2025 10:00:00", None), ("05.06.2025 10:00:00", "dotted-dmy"), ("06.25.2025 10:00:00", None)]
    df = spark.createDataFrame(rows, "stamp string, want string")
    got = normalize_timestamps(df, "stamp", conventions=CONVENTIONS).collect()
    assert [(r["reading"], r["utc_ms"] is None, r["ambiguous"]) for r in got if r["want"] is None] == [(None, True, False)] * 2
    assert all(r["reading"] == r["want"] for r in got)
    assert {r["reading"] for r in normalize_timestamps(df, "stamp").where("want is null").collect()} == {"slashed-dmy", "dotted-mdy"}

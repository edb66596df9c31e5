"""Mixed timestamps against literal expectations and against the standard library's zone rules."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmetry.operators import timestamps as ts


def us(*a: int, micro: int = 0) -> int:
    return int((datetime(*a, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)) + micro


CASES = [
    ("2010-12-17T06:06:29Z", "UTC", "MDY", us(2010, 12, 17, 6, 6, 29)),
    ("2010-12-17T06:06:29z", "UTC", "MDY", us(2010, 12, 17, 6, 6, 29)),
    ("20101012T172600Z", "Asia/Tokyo", "DMY", us(2010, 10, 12, 17, 26)),
    ("2010-12-17 05:40:52", "America/New_York", "MDY", us(2010, 12, 17, 10, 40, 52)),
    ("2011-01-04", "Europe/London", "DMY", us(2011, 1, 4)),
    ("2011-03-28T19:07:59-0400", "UTC", "MDY", us(2011, 3, 28, 23, 7, 59)),
    ("2010-12-11T15:59:10.731635205Z", "UTC", "MDY", us(2010, 12, 11, 15, 59, 10, micro=731635)),
    ("1295092214", "Asia/Tokyo", "DMY", 1295092214_000_000),
    ("1291660331415", "Asia/Tokyo", "DMY", 1291660331415_000),
    ("1295524622508926", "Asia/Tokyo", "DMY", 1295524622508926),
    ("12/08/2010 4:48 am", "America/New_York", "MDY", us(2010, 12, 8, 9, 48)),
    ("12/08/2010 12:10 am", "UTC", "DMY", us(2010, 8, 12, 0, 10)),
    ("05/13/2011 8:50 AM EDT", "America/New_York", "MDY", us(2011, 5, 13, 12, 50)),
    ("28/06/2013 7:41 AM IST", "Asia/Kolkata", "DMY", us(2013, 6, 28, 2, 11)),
    ("14 February 2011", "Asia/Kolkata", "DMY", us(2011, 2, 13, 18, 30)),
    ("27 May 2011 12:01 CDT", "America/Chicago", "MDY", us(2011, 5, 27, 17, 1)),
    ("April 16, 2011 at 8:19 pm EDT", "America/New_York", "MDY", us(2011, 4, 17, 0, 19)),
    ("Fri, 19 Nov 2010 05:28:19 GMT", "Asia/Tokyo", "DMY", us(2010, 11, 19, 5, 28, 19)),
    ("2011-11-06 01:30:00", "America/New_York", "MDY", us(2011, 11, 6, 5, 30)),  # twice: the first
    ("2011-03-13 02:30:00", "America/New_York", "MDY", us(2011, 3, 13, 7, 30)),  # skipped: the offset before
    ("0000-00-00 00:00:00", "UTC", "MDY", None),
    ("2011-02-30", "UTC", "MDY", None),
    ("2011-02-20 25:00", "UTC", "MDY", None),
    ("unknown", "UTC", "MDY", None),
    ("", "UTC", "MDY", None),
    (None, None, None, None),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, v, f"s{o}", z, o) for i, (v, z, o, _) in enumerate(CASES)], "i int, value string, source string, tz string, ord string")
    got = {r.i: r.instant_us for r in ts.normalise_timestamps(df, "value", "source", "tz", "ord").collect()}
    assert got == {i: want for i, (*_, want) in enumerate(CASES)}


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Berlin", "Australia/Sydney", "America/Phoenix"])
def test_wall_clocks_follow_the_zone(spark, zone):
    walls = [datetime(2014, 1, 1) + timedelta(hours=7 * k, minutes=13) for k in range(1300)]
    df = spark.createDataFrame([(w.strftime("%Y-%m-%d %H:%M:%S"), "s", zone, "MDY") for w in walls], "value string, source string, tz string, ord string")
    got = [r.instant_us for r in ts.normalise_timestamps(df, "value", "source", "tz", "ord").orderBy("value").collect()]
    assert got == [int(w.replace(tzinfo=ZoneInfo(zone), fold=0).timestamp()) * 1_000_000 for w in walls]


def test_mixture_learns_the_order_and_marks_doubt(spark):
    """Without a documented order, values with one reading decide; a source with none stays ambiguous."""
    rows = [("a", "13/02/2011"), ("a", "25/12/2012"), ("a", "04/05/2013"), ("b", "04/05/2013"), ("c", "12/31/2010"), ("c", "11/30/2010"), ("c", "01/02/2011")]
    df = spark.createDataFrame([(s, v, "UTC", None) for s, v in rows], "source string, value string, tz string, ord string")
    got = {(r.source, r.value): r for r in ts.normalise_timestamps(df, "value", "source", "tz", "ord").collect()}
    assert got["a", "04/05/2013"].instant_us == us(2013, 5, 4) and got["c", "01/02/2011"].instant_us == us(2011, 1, 2)
    assert got["b", "04/05/2013"].ambiguous and not got["a", "13/02/2011"].ambiguous


def test_the_mixture_decides(spark):
    """Values of a source that deny its documented order a hundredfold decide, at any size; a few strays don't."""
    late = [("s", f"{d:02d}/{m:02d}/2012", "UTC", "MDY") for d in range(13, 28) for m in range(1, 13)]
    doubtful = ("s", "04/05/2012", "UTC", "MDY")
    for times, want in ((1, us(2012, 5, 4)), (7, us(2012, 5, 4))):
        df = spark.createDataFrame([*late * times, doubtful], "source string, value string, tz string, ord string")
        got = ts.normalise_timestamps(df, "value", "source", "tz", "ord").filter("value = '04/05/2012'").first()
        assert got.instant_us == want and got.posterior > 0.5
    few = [("s", "13/05/2012", "UTC", "MDY"), *[("s", f"0{m}/{d}/2012", "UTC", "MDY") for m in range(1, 9) for d in range(13, 20)], doubtful]
    df = spark.createDataFrame(few, "source string, value string, tz string, ord string")
    assert ts.normalise_timestamps(df, "value", "source", "tz", "ord").filter("value = '04/05/2012'").first().instant_us == us(2012, 4, 5)


def test_abbreviations_with_several_meanings(spark):
    rows = [("a", "28 June 2013 7:41 AM IST", "Europe/Dublin"), ("b", "28 June 2013 7:41 AM IST", "Asia/Jerusalem"), ("c", "28 June 2013 7:41 AM IST", None), ("d", "28 June 2013 07:41 CST", "Asia/Shanghai")]
    df = spark.createDataFrame([(*r, "MDY") for r in rows], "source string, value string, tz string, ord string")
    got = {r.source: r for r in ts.normalise_timestamps(df, "value", "source", "tz", "ord").collect()}
    assert [got[k].instant_us for k in "abd"] == [us(2013, 6, 28, 6, 41), us(2013, 6, 28, 5, 41), us(2013, 6, 27, 23, 41)]
    assert got["c"].ambiguous and got["c"].instant_us == us(2013, 6, 28, 2, 11)


def test_em_finds_the_maximum_of_the_likelihood():
    rng = np.random.default_rng(4)
    sets, docs, n = [["md"], ["dm"], ["md", "dm"]], [[0.5], [0.5], [0.5, 0.5]], rng.integers(1, 60, 3).astype(float)
    w = ts.fit_weights(sets, docs, n, steps=500, pseudo=0.0)
    assert w["md"] == pytest.approx(n[0] / (n[0] + n[1]), abs=1e-6)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([("1295092214", "s", "UTC", "MDY", 7, "w", 3)], "value string, source string, tz string, ord string, extra int, weights string, n int")
    row = ts.normalise_timestamps(df, "value", "source", "tz", "ord").first()
    assert (row.extra, row.weights, row.n, row.instant_us) == (7, "w", 3, 1295092214_000_000)
    assert ts.normalise_timestamps(df.filter(F.lit(False)), "value", "source", "tz", "ord").count() == 0

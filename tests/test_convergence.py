"""Convergence windows on small hand-made signals, and on none."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillmetry.operators import convergence as cv

D = dt.date


def signals(spark, points=(), velocities=(), similarity=(), curve=(), monthly=(), axes=()):
    return {
        "points": spark.createDataFrame(list(points), "entity bigint, day date, feature string, family string, strength double, d double, extra int"),
        "velocities": spark.createDataFrame(list(velocities), "entity bigint, month date, v double"),
        "similarity": spark.createDataFrame(list(similarity), "entity bigint, day date, s double"),
        "curve": spark.createDataFrame(list(curve), "entity bigint, month date, v double"),
        "monthly": spark.createDataFrame(list(monthly), "entity bigint, month date, perplexity double, burstiness double, spread double"),
        "axes": spark.createDataFrame(list(axes), "entity bigint, axes bigint"),
    }


def test_no_signals_no_windows(spark):
    assert cv.convergence(**signals(spark)).count() == 0


def test_scores_of_one_window(spark):
    points = [(1, D(2020, 1, 10), "a", "f1", 0.9, 1.0, 7), (1, D(2020, 1, 20), "b", "f1", 0.9, -5.0, 7), (1, D(2020, 2, 1), "c", "f2", 0.5, 0.5, 7), (1, D(2020, 12, 1), "d", "f3", 1.0, 1.0, 7), (1, None, "e", "f3", 1.0, 1.0, 7), (1, D(2020, 1, 11), "u", None, 1.0, 1.0, 7)]
    velocities = [(1, D(2020, m, 1), v) for m, v in ((1, 0.1), (2, 0.1), (3, 0.9), (8, 0.1), (9, None))]
    similarity = [(1, D(2020, 1, d), s) for d, s in ((12, 1.0), (15, 1.0), (18, 0.4), (21, 0.4))]
    curve = [(1, D(2020, 1, 1), 0.1), (1, D(2020, 3, 1), 0.3), (1, D(2020, 4, 1), 9.0)]
    monthly = [(1, D(2020, 1, 1), 100.0, 1.0, 0.1), (1, D(2020, 2, 1), 80.0, 0.99, 0.3), (2, D(2020, 1, 1), 1.0, 1.0, 1.0)]
    out = cv.convergence(**signals(spark, points, velocities, similarity, curve, monthly, [(1, 4)]))
    row = out.filter(F.col("start") == F.lit(D(2020, 1, 10))).first()
    assert row.stop == D(2020, 4, 9) and row.points == 3 and row.converging == "f1,f2" and row.features == "b,c"
    assert row.a == pytest.approx((1.0 + 0.25) / 2) and row.ratio == pytest.approx(0.5)
    mean, sd = 0.3, 0.4  # of 0.1, 0.1, 0.9, 0.1
    assert row.peak == pytest.approx((0.9 - mean) / (2 * sd)) and row["drop"] == pytest.approx(0.6 / 1.05)
    assert row.rise == pytest.approx(0.4)  # April has no velocity
    assert row.b == pytest.approx((row.peak + row["drop"] + row.rise) / 3)
    assert row.c == pytest.approx((1.0 + 0.5 + 0.2) / 3) and row.via == "ratio,ab,drift_only" and row.admitted
    last = out.filter(F.col("start") == F.lit(D(2020, 12, 1))).first()
    assert last.b == 0.0 and last.ratio == pytest.approx(0.25) and not last.admitted and last.c == 0.0


def test_missing_signals_are_zero_and_ties_are_early(spark):
    points = [(1, D(2020, 1, 2), "z", "f", 0.5, 1.0, 0), (1, D(2020, 1, 1), "y", "f", 0.5, -1.0, 0), (1, D(2020, 1, 1), "x", "f", 0.5, 1.0, 0), (1, D(2020, 1, 1), "x", "f", 0.5, 1.0, 0)]
    row = cv.convergence(**signals(spark, points)).filter(F.col("start") == F.lit(D(2020, 1, 1))).first()
    assert row.features == "x" and row.points == 4 and row.ratio == 0.0 and row.c is None and row.rise == 0.0
    flat = [(1, D(2020, m, 1), 0.2) for m in (1, 2, 3)]
    assert cv.convergence(**signals(spark, points, flat)).agg(F.max("peak")).first()[0] == 0.0


@pytest.mark.parametrize("values,want", [([], 0.0), ([5.0], 0.0), ([1.0, 1.0], 0.0), ([1.0, 0.95], 0.5), ([1.0, 0.9], 1.0), ([2.0, 1.0, 1.0], 1.0), ([0.0, -1.0], 0.0), ([1.0, 2.0], 0.0)])
def test_halves(spark, values, want):
    df = spark.createDataFrame([(values,)], "v array<double>")
    assert df.select(cv.halves_drop(F.col("v"), 0.92).alias("x")).first().x == want

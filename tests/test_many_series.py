"""What runs over many series at once, against one series at a time."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from quillmetry.operators import analysis as an
from quillmetry.operators import changepoints as cp


def shifted(lengths: tuple[int, ...]) -> list[np.ndarray]:
    rng = np.random.default_rng(11)
    return [np.round(np.r_[rng.normal(0, 1, n // 2), rng.normal(s, 1, n - n // 2)], digits) * k + o for n in lengths for s in (0, 1, 4) for digits in (0, 9) for k, o in ((1, 0), (1e-3, 5), (1e5, 1e6))]


def test_online_detection_of_many_series():
    xs = shifted((5, 7, 12, 40, 150))
    hazards = [min(0.5, 3 / len(x)) for x in xs]
    near = [x - x[:10].mean() for x in xs]  # far from 0, the sums of one series at a time lose digits
    for raw, one, many in zip(*([cp.bocpd(x, h) for x, h in zip(v, hazards)] for v in (xs, near)), cp.bocpd_many(xs, hazards)):
        assert [t for t, _ in raw] == [t for t, _ in one] == [t for t, _ in many] and np.allclose([p for _, p in one], [p for _, p in many], rtol=1e-9)
    xs = shifted((500,))
    took = []
    for run in (lambda: cp.bocpd_many(xs, [0.01] * len(xs)), lambda: [cp.bocpd(x, 0.01) for x in xs]):
        began = time.thread_time()
        run()
        took.append(time.thread_time() - began)
    assert took[0] < 0.5 * took[1]


def test_changes_of_many_series(spark):
    xs = shifted((8, 30, 90))
    rows = [(e, k // 2, k, None if k == 6 and e % 2 else float(v)) for e, x in enumerate(xs) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "e bigint, d int, tie bigint, v double").withColumn("ts", F.expr("timestamp'2020-01-01' + make_interval(0, 0, 0, d)"))
    found = an.changes(an.long_form(df.repartition(5), "e", "ts", ["tie"], {"v": "v"})).collect()
    want = []
    for e, x in enumerate(xs):
        x = cp.finite(np.array([np.nan if k == 6 and e % 2 else v for k, v in enumerate(x)]))
        if len(x) >= 10:
            want += [(e, "pelt", at, d) for at, d, _, _ in cp.break_rows(x, [(b, None) for b in cp.pelt(x, 3 * float(x.std()))])]
            want += [(e, "bocpd", at, d) for at, d, _, _ in cp.break_rows(x, cp.bocpd(x, 3 / len(x)))]
    assert sorted((r.entity, r.method, r["at"], r.d) for r in found) == sorted(want) and {m for _, m, _, _ in want} == {"pelt", "bocpd"}
    assert all((r.ts - found[0].ts).days == r["at"] // 2 - found[0]["at"] // 2 for r in found)


def test_intervals_of_many_splits():
    xs = shifted((40, 43))
    splits = [(x, k) for x in xs for k in (10, 25, 30)] + [(xs[0][:31], 11)]
    for (x, k), got in zip(splits, cp.bootstrap_cis(splits, n=200)):
        assert np.allclose(got, cp.bootstrap_ci(x[:k], x[k:], n=200), rtol=1e-9, atol=1e-12)
    assert [cp.two_sample(x[:k], x[k:]) for x in xs for k in (5, 20)] == [t for x in xs for t in cp.two_samples(x, [5, 20])]
    many = [(x, k) for x in shifted((300,)) for k in (150, 155)] * 4
    took = []
    for run in (lambda: cp.bootstrap_cis(many), lambda: [cp.bootstrap_ci(x[:k], x[k:]) for x, k in many]):
        began = time.thread_time()
        run()
        took.append(time.thread_time() - began)
    assert took[0] < 0.5 * took[1]


def test_tests_of_many_series(spark):
    xs = shifted((12, 60))
    rows = [(e, k, k, float(v)) for e, x in enumerate(xs) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "e bigint, d int, tie bigint, v double").withColumn("ts", F.expr("timestamp'2020-01-01' + make_interval(0, 0, 0, d)"))
    found = df.filter("d in (4, 30, 50)").selectExpr("e as entity", "'v' as feature", "'m' as method", "ts")
    got = {(r.entity, r["at"], r.test): r for r in an.tests_at(an.long_form(df, "e", "ts", ["tie"], {"v": "v"}), found.unionByName(found.withColumn("entity", F.lit(999)))).collect()}
    assert len(got) == sum(1 if len(x) == 12 else 7 for x in xs) and all(r.skipped == "short_segment" for (_, at, _), r in got.items() if at == 4)
    for (e, at, test), r in got.items():
        if test != "none":
            a, b = xs[e][:at], xs[e][at:]
            assert {(n, s, p) for n, s, p in cp.two_sample(a, b) if n == test} == {(test, r.statistic, r.p)} and r.d == cp.special.cohens_d(a, b)
            assert np.allclose((r.ci_lo, r.ci_hi), cp.bootstrap_ci(a, b), rtol=1e-9, atol=1e-12)


def test_labels_in_all_orders_at_once(spark):
    rng = np.random.default_rng(4)
    days = np.sort(rng.integers(0, 300, 130))
    names = rng.integers(0, 5, 130)
    points = spark.createDataFrame([(7, int(d), f"f{k}") for d, k in zip(days, names)], "entity bigint, d int, feature string").selectExpr("entity", "date_add(date'2020-01-01', d) as day", "feature")
    windows = points.selectExpr("entity", "day as start", "date_add(day, 3) as stop").distinct()
    r = an.label_permutation(points, windows, 5, n=50).first()
    labels = np.array([k for _, k in sorted(zip(days, names))])
    share = lambda x: max(len(set(x[(days >= d) & (days <= d + 3)])) for d in days) / 5
    draws = np.random.default_rng([42, 7])
    null = [share(draws.permutation(labels)) for _ in range(50)]
    assert (r.observed, r.null_mean) == (share(labels), float(np.mean(null))) and r.p == (sum(x >= share(labels) for x in null) + 1) / 51
    spans = sorted({(int(np.searchsorted(days, d)), int(np.searchsorted(days, d + 3, "right"))) for d in days})
    began = time.thread_time()
    an._most_labels(np.tile(labels, (1000, 1)), spans)
    assert time.thread_time() - began < 0.3  # a second and more, window by window
    outside = windows.selectExpr("entity", "date_add(start, 1000) as start", "date_add(stop, 1000) as stop")
    assert an.label_permutation(points, outside, 5, n=50).first()[1:] == (0.0, 0.0, 1.0)


def test_plan_of_the_whole_analysis_stays_small(spark, monkeypatch):
    import __spark_entry__ as entry
    from quillmetry.operators import ranks

    original = ranks.ranked
    monkeypatch.setattr(ranks, "ranked", lambda df, order, groups=None, rank="rk", total="n": original(df, order, groups, rank, total) if rank != "place" else df.withColumn("_range", F.lit(0)))
    plan = entry.queries()["entity_analysis"](spark, entry.SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("Join ") <= 3  # of written tables only: the windows are planned by themselves

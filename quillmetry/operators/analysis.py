"""The analysis of many series at once: long tables of features, changes by several methods, tests, gates, profiles.

The spine is the long form entity, feature, ts, tie, value (and section). A group of Python is one feature of one entity;
everything across entities is a plan. Values that aren't finite count as missing; series take their median instead.

Defined results: series under ten values, and flat ones, have no changes. Splits with a side too short give a row with a
reason and no p. Tests that can't be ranked (skipped, degenerate, no finite p) keep their row, take no part in the
correction and are never significant. Empty tables give empty ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillmetry.functions import special
from quillmetry.operators import changepoints as cp
from quillmetry.operators import ranks


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([special.t_sf2(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df)], dtype=float)


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([special.f_sf(a, b, c) if pd.notna(a) else None for a, b, c in zip(f, d1, d2)], dtype=float)


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([special.chi2_sf(a, b) if pd.notna(a) and b > 0 else None for a, b in zip(x, df)], dtype=float)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([special.normal_sf2(a) if pd.notna(a) else None for a in z], dtype=float)


def clamp_p(p: Column) -> Column:
    """Not finite: 1; else between 0 and 1."""
    return F.when(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


# ---- series ----


def long_form(df: DataFrame, entity: str, ts: str, tie: list[str], features: dict[str, str], section: str | None = None) -> DataFrame:
    """entity, ts, tie, section, feature, value, from columns or expressions; one scan, no join."""
    values = F.array(*[F.struct(F.lit(name).alias("feature"), F.expr(x).cast("double").alias("value")) for name, x in features.items()])
    return df.select(F.col(entity).alias("entity"), F.col(ts).alias("ts"), F.struct(*tie).alias("tie"), (F.col(section) if section else F.lit(None).cast("string")).alias("section"), F.explode(values).alias("x")).select("entity", "ts", "tie", "section", "x.feature", "x.value")


def residualised(long: DataFrame, least: int = 10) -> DataFrame:
    """Values less their section's mean plus the entity's, where at least two sections have `least` values."""
    own, part = Window.partitionBy("entity", "feature"), Window.partitionBy("entity", "feature", "section")
    x = long.withColumns({"_n": F.count("value").over(part), "_s": F.avg("value").over(part), "_g": F.avg("value").over(own)})
    x = x.withColumn("_e", F.size(F.collect_set(F.when(F.col("_n") >= least, F.col("section"))).over(own)))
    return x.withColumn("value", F.when((F.col("_e") >= 2) & (F.col("_n") >= least), F.col("value") - F.col("_s") + F.col("_g")).otherwise(F.col("value"))).select(*long.columns)


def rolling(long: DataFrame, windows: tuple[int, ...] = (30, 90)) -> DataFrame:
    """Adds the mean and deviation of the last 30 and 90 rows of each entity's feature."""
    order = Window.partitionBy("entity", "feature").orderBy("ts", "tie")
    out = long
    for k in windows:
        w = order.rowsBetween(1 - k, 0)
        out = out.withColumns({f"mean_{k}": F.avg("value").over(w), f"std_{k}": F.coalesce(F.stddev_samp("value").over(w), F.lit(0.0))})
    return out


def decomposed(long: DataFrame, period: int = 30) -> DataFrame:
    """entity, feature, i, trend, seasonal, rest of every series."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(tie=g["tie"].map(lambda t: tuple(t.values()) if isinstance(t, dict) else t)).sort_values(["ts", "tie"])
        rows = cp.decompose(cp.finite(g["value"].to_numpy(float)), period)
        return pd.DataFrame([(g["entity"].iloc[0], g["feature"].iloc[0], *r) for r in rows], columns=["entity", "feature", "i", "trend", "seasonal", "rest"])

    return long.groupBy("entity", "feature").applyInPandas(run, "entity bigint, feature string, i int, trend double, seasonal double, rest double")


#: Time of a value without one, after all others.
_NEVER = 2**63 - 1


def series_rows(long: DataFrame) -> DataFrame:
    """entity, feature, ts (microseconds), value: a row per series, its values in the order of ts and tie."""
    item = F.struct(F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(_NEVER)).alias("ts"), "tie", "value")
    rows = long.groupBy("entity", "feature").agg(F.array_sort(F.collect_list(item)).alias("s"))
    return rows.select("entity", "feature", F.col("s.ts").alias("ts"), F.col("s.value").alias("value"))


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The arrays of a column of lists."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _named(batch: pa.RecordBatch, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """A batch of rows that begin with the place of their series in the batch; it becomes entity and feature."""
    at, *columns = zip(*rows) if rows else [[] for _ in schema.names[1:]]
    own = batch.select(["entity", "feature"]).take(pa.array(at, "int64"))
    return pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:]))], names=schema.names)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


CHANGES = "entity bigint, feature string, method string, at int, ts bigint, d double, direction string, confidence double"


def changes(long: DataFrame, methods: tuple[str, ...] = ("pelt", "bocpd"), penalty: float = 3.0, suffix: str = "", expected: float = 3.0) -> DataFrame:
    """Breaks of every feature of every entity by every method. The hazard is `expected` breaks by the length of the series."""

    def run(batches):
        for batch in batches:
            times = _lists(batch.column("ts"))
            xs = [cp.finite(x) for x in _lists(batch.column("value"))]
            live = [i for i, x in enumerate(xs) if len(x) >= 10 and x.std() >= 1e-9]
            rows: list[tuple] = []
            for m in methods:
                if m == "pelt":
                    found = [[(b, None) for b in cp.pelt(xs[i], penalty * float(xs[i].std()))] for i in live]
                else:
                    found = cp.bocpd_many([xs[i] for i in live], [min(0.5, expected / len(xs[i])) for i in live])
                for i, breaks in zip(live, found):
                    rows += [(i, m + suffix, at, int(times[i][at]), d, way, p) for at, d, way, p in cp.break_rows(xs[i], breaks)]
            yield _named(batch, rows, _schema(CHANGES))

    out = series_rows(long.select(F.col("entity").cast("long"), "feature", "ts", "tie", F.col("value").cast("double"))).mapInArrow(run, CHANGES)
    return out.withColumn("ts", F.when(F.col("ts") < _NEVER, F.timestamp_micros("ts")))


TESTS = "entity bigint, feature string, method string, at int, test string, statistic double, p double, d double, ci_lo double, ci_hi double, skipped string, degenerate boolean"


def tests_at(long: DataFrame, found: DataFrame, least: int = 10, seed: int = 42) -> DataFrame:
    """The two-sample tests at each break: the series is imputed once, the break is the first value at or after its time.

    Series of like length come together, since splits of the same sizes share the draws of their intervals.
    """

    def run(batches):
        for batch in batches:
            columns = [_lists(batch.column(c)) for c in ("ts", "value", "at", "method")]
            rows: list[tuple] = []
            todo: list[tuple] = []
            for i, (ts, x, at, methods) in enumerate(zip(*columns)):
                if len(x) < 6:
                    continue
                x = cp.finite(x)
                places = np.clip(np.searchsorted(ts, at, "left"), 1, len(x) - 1).tolist()
                for k, method in zip(places, methods):
                    if k < least or len(x) - k < least:
                        rows.append((i, method, k, "none", None, None, None, None, None, "short_segment", False))
                fit = sorted({k for k in places if k >= least and len(x) - k >= least})
                tests = dict(zip(fit, cp.two_samples(x, fit)))
                todo += [(i, x, k, [m for p, m in zip(places, methods) if p == k], tests[k]) for k in fit]
            for (i, x, k, methods, tests), (lo, hi) in zip(todo, cp.bootstrap_cis([(x, k) for _, x, k, _, _ in todo], seed=seed)):
                a, b = special.moments(x[:k]), special.moments(x[k:])
                flat = all(math.sqrt(v * (n - 1) / n) < 1e-12 for n, _, v in (a, b))
                d = special.effect(a, b)
                rows += [(i, method, k, name, stat, pv, d, lo, hi, None, flat) for method in methods for name, stat, pv in tests]
            yield _named(batch, rows, _schema(TESTS))

    s = series_rows(long.select(F.col("entity").cast("long"), "feature", "ts", "tie", F.col("value").cast("double")))
    breaks = found.groupBy(F.col("entity").cast("long").alias("_e"), F.col("feature").alias("_f")).agg(F.collect_list(F.struct(F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(_NEVER)).alias("at"), "method")).alias("b"))
    met = s.join(breaks, F.col("entity").eqNullSafe(F.col("_e")) & F.col("feature").eqNullSafe(F.col("_f")))
    near = met.select("entity", "feature", "ts", "value", F.col("b.at").alias("at"), F.col("b.method").alias("method"), F.size("value").alias("_n"))
    near = near.repartitionByRange(max(1, long.sparkSession.sparkContext.defaultParallelism), "_n", "entity", "feature").sortWithinPartitions("_n").drop("_n")
    return near.mapInArrow(run, TESTS)


def rankable(p: str = "p", skipped: str = "skipped", degenerate: str = "degenerate") -> Column:
    """Not skipped, not degenerate, with a finite p."""
    return F.col(skipped).isNull() & ~F.coalesce(F.col(degenerate), F.lit(False)) & F.col(p).isNotNull() & ~F.isnan(p)


def gated(tests: DataFrame, key: str, alpha: float = 0.05, least_d: float = 0.5) -> DataFrame:
    """Adds q (one correction over all entities) and significant: q under alpha and an effect of least_d or more."""
    ok = rankable()
    kept = ranks.benjamini_hochberg(tests.filter(ok), "p", key)
    rest = tests.filter(~ok).withColumn("q", F.lit(None).cast("double"))
    sure = F.coalesce((F.col("q") < alpha) & (F.abs("d") >= least_d), F.lit(False))
    return kept.unionByName(rest).withColumn("significant", sure)


def across_entities(tests: DataFrame, entity: str, family: str, q: str = "q") -> DataFrame:
    """Second pass: each entity's smallest q of a family, corrected over the entities and stamped on all rows of both.

    Adds q_across and reason: 'single_entity' where a family has one entity (its q stays), null otherwise.
    """
    least = tests.filter(F.col(q).isNotNull()).groupBy(entity, family).agg(F.min(q).alias("_p"))
    n = least.groupBy(family).agg(F.count("*").alias("_n"))
    second = ranks.benjamini_hochberg(least, "_p", entity, [family], "_q2").join(n, family).drop("_p")
    out = tests.join(second, [entity, family], "left")
    one = F.col("_n") == 1
    return out.withColumns({"q_across": F.when(one, F.col(q)).otherwise(F.greatest(F.col(q), F.col("_q2"))), "reason": F.when(one, "single_entity")}).drop("_q2", "_n")


# ---- sections ----


def kruskal(long: DataFrame, sections: DataFrame) -> DataFrame:
    """feature, h, k, n, p, eta: the omnibus test of each feature over the sections.

    Values are counted by value and section first; the ranks of the values come from ranges, so no feature is one task.
    """
    v = long.filter(F.col("value").isNotNull() & ~F.isnan("value")).join(F.broadcast(sections.select("section")), "section")
    counts = v.groupBy("feature", "value", "section").agg(F.count("*").alias("c"))
    totals = counts.groupBy("feature", "value").agg(F.sum("c").alias("t"))
    placed = ranks.with_sum_before(totals, "value", "t", ["feature"])
    r = counts.join(placed, ["feature", "value"]).withColumn("rank", F.col("before") + (F.col("t") + 1) / 2)
    by = r.groupBy("feature", "section").agg(F.sum("c").cast("double").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("r"))
    ties = totals.groupBy("feature").agg(F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"), F.count("*").alias("values"))
    h = by.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s")).join(ties, "feature")
    n = F.col("n")
    raw = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    h = h.withColumn("h", F.when((F.col("k") >= 2) & (F.col("values") >= 2), raw))
    eta = F.when(n > F.col("k"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("h") - F.col("k") + 1) / (n - F.col("k")))))
    return h.select("feature", "h", "k", n.cast("long").alias("n"), chi2_p("h", (F.col("k") - 1).cast("double")).alias("p"), F.coalesce(eta, F.lit(0.0)).alias("eta"))


def retained_sections(long: DataFrame, least: int = 30, authors: int = 2) -> DataFrame:
    """section, n, authors of the sections with enough rows and authors; rows are counted once, not per feature."""
    one = long.select("entity", "section", "ts", "tie").distinct()
    return one.groupBy(F.coalesce("section", F.lit("unknown")).alias("section")).agg(F.count("*").alias("n"), F.count_distinct("entity").alias("authors")).filter((F.col("n") >= least) & (F.col("authors") >= authors))


def section_distances(long: DataFrame, sections: DataFrame) -> DataFrame:
    """a, b, distance of the sections' mean features; 1 where one of them is zero. Sections are a small dimension."""
    c = long.join(F.broadcast(sections.select("section")), "section").groupBy("section", "feature").agg(F.avg("value").alias("m")).filter("m is not null")
    size = c.groupBy("section").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("len"))
    dots = c.alias("x").join(c.alias("y"), "feature").filter("x.section < y.section").groupBy(F.col("x.section").alias("a"), F.col("y.section").alias("b")).agg(F.sum(F.col("x.m") * F.col("y.m")).alias("dot"))
    d = dots.join(size.select(F.col("section").alias("a"), F.col("len").alias("la")), "a").join(size.select(F.col("section").alias("b"), F.col("len").alias("lb")), "b")
    cosine = F.col("dot") / (F.col("la") * F.col("lb"))
    return d.select("a", "b", F.when(F.col("la") * F.col("lb") == 0, 1.0).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))).alias("distance"))


def profile(long: DataFrame, families: dict[str, str], alpha: float = 0.01, least_families: int = 3, least_distance: float = 0.3, least: int = 30) -> DataFrame:
    """One row: sections kept, families with a significant omnibus test, largest distance, and the verdict on both."""
    long = long.withColumn("section", F.coalesce("section", F.lit("unknown")))
    kept = retained_sections(long, least)
    family = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])
    tests = kruskal(long, kept).withColumn("family", F.try_element_at(family, F.col("feature")))
    sure = tests.filter((F.col("p") < alpha) & F.col("family").isNotNull()).agg(F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count_distinct("family").alias("n_families"))
    far = section_distances(long, kept).agg(F.coalesce(F.max("distance"), F.lit(0.0)).alias("max_distance"))
    n = kept.agg(F.count("*").alias("sections"))
    hits = (F.col("n_families") >= least_families).cast("int") + (F.col("max_distance") > least_distance).cast("int")
    verdict = F.when(F.col("sections") < 2, "DEGENERATE").when(hits == 2, "PASS").when(hits == 1, "BORDERLINE").otherwise("FAIL")
    return n.crossJoin(sure).crossJoin(far).withColumn("verdict", verdict)


def contrast(long: DataFrame, families: dict[str, str], least: int = 30, alpha: float = 0.05) -> DataFrame:
    """entity, a, b, n_a, n_b, family, features: what tells two sections of an entity apart, by Welch or by ranks.

    Of each pair of sections with `least` rows every feature is tested twice; a family's tests are corrected together; a
    feature counts if either corrected p is under alpha. Pairs without such a feature have a row with family null.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        sizes = g[g["feature"] == g["feature"].iloc[0]].groupby("section").size()
        names = sorted(sizes[sizes >= least].index)
        parts = {(s, f): x["value"].to_numpy(float) for (s, f), x in g.groupby(["section", "feature"])}
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                tests: dict[str, list[tuple[str, float]]] = {}
                for f, family in families.items():
                    p, q = (v[np.isfinite(v)] for v in (parts.get((a, f), np.zeros(0)), parts.get((b, f), np.zeros(0))))
                    if len(p) >= 2 and len(q) >= 2:
                        tests.setdefault(family, []).extend((f, pv if math.isfinite(pv) else 1.0) for _, _, pv in cp.two_sample(p, q)[:2])
                hits = {family: sorted({f for (f, _), c in zip(rows, special.bh([p for _, p in rows])) if c < alpha}) for family, rows in tests.items()}
                hits = {k: v for k, v in sorted(hits.items()) if v} or {None: []}
                out += [(g["entity"].iloc[0], a, b, int(sizes[a]), int(sizes[b]), k, ",".join(v)) for k, v in hits.items()]
        return pd.DataFrame(out, columns=["entity", "a", "b", "n_a", "n_b", "family", "features"])

    x = long.withColumn("section", F.coalesce("section", F.lit("unknown"))).select("entity", "section", "feature", "value")
    return x.groupBy("entity").applyInPandas(run, "entity bigint, a string, b string, n_a bigint, n_b bigint, family string, features string")


def _most_labels(labels: np.ndarray, inside: list[tuple[int, int]]) -> np.ndarray:
    """labels: a row per order of the same labels. The largest number of distinct labels in any of the spans, of each row."""
    rows, n = labels.shape
    lo, hi = (np.array(x) for x in zip(*inside))
    kind = np.int16 if n < 2**15 else np.int32
    across = np.ascontiguousarray(labels.T)
    distinct, upto = np.zeros((len(inside), rows), np.int32), np.zeros((n + 1, rows), kind)
    for name in np.unique(labels[0]):
        np.cumsum(across == name, axis=0, out=upto[1:], dtype=kind)
        distinct += upto[hi] > upto[lo]
    return distinct.max(0)


def label_permutation(points: DataFrame, windows: DataFrame, total: int, n: int = 1000, seed: int = 42) -> DataFrame:
    """entity, observed, null_mean, p: the largest share of distinct features in an entity's windows, against shuffled labels.

    points: entity, day, feature; windows: entity, start, stop. Every entity has a seed of its own. All orders are counted
    together. Without a window that holds a point every share is 0.
    """

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["entity", "observed", "null_mean", "p"])
        a = a.sort_values(["day", "feature"])
        _, labels = np.unique(a["feature"], return_inverse=True)
        days = pd.to_datetime(a["day"]).to_numpy()
        starts, stops = (pd.to_datetime(b[c]).to_numpy() for c in ("start", "stop"))
        spans = zip(np.searchsorted(days, starts, "left").tolist(), np.searchsorted(days, stops, "right").tolist())
        inside = sorted({(lo, hi) for lo, hi in spans if hi > lo})
        seen, null = 0.0, np.zeros(n)
        if inside:
            rng = np.random.default_rng([seed, int(a["entity"].iloc[0])])
            seen = _most_labels(labels[None, :], inside)[0] / total
            step = max(1, (1 << 20) // len(labels))
            null = np.concatenate([_most_labels(rng.permuted(np.tile(labels, (min(step, n - at), 1)), axis=1), inside) for at in range(0, n, step)]) / total
        return pd.DataFrame([(a["entity"].iloc[0], seen, float(null.mean()), float(((null >= seen).sum() + 1) / (n + 1)))], columns=["entity", "observed", "null_mean", "p"])

    spark = points.sparkSession  # few bytes an entity, but much work: the partitions aren't to be put together by their bytes
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left = points.select("entity", "day", "feature").repartition(parts, "entity").groupBy("entity")
    return left.cogroup(windows.select(F.col("entity").alias("_entity"), "start", "stop").repartition(parts, "_entity").groupBy("_entity")).applyInPandas(run, "entity bigint, observed double, null_mean double, p double")


def calibration(series: DataFrame, trials: int = 5, shift: float = 2.0, tolerance: int = 10, penalty: float = 5.0, seed: int = 42) -> DataFrame:
    """series: entity, i, value. entity, trial, planted, found, error of trials with and without a planted shift.

    The place of a shift is drawn between 30 and 70 % of the series, from a seed of entity and trial.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = cp.finite(g.sort_values("i")["value"].to_numpy(float))
        rows = []
        for t in range(2 * trials):
            rng = np.random.default_rng([seed, int(g["entity"].iloc[0]), t])
            at = int(rng.integers(int(0.3 * len(x)), max(int(0.3 * len(x)) + 1, int(0.7 * len(x)))))
            y = rng.permutation(x)
            if t < trials:
                y[at:] += shift * x.std()
            breaks = cp.pelt(y, penalty * float(y.var()))
            error = min((abs(b - at) for b in breaks), default=None)
            found = bool(breaks) if t >= trials else error is not None and error <= tolerance
            rows.append((g["entity"].iloc[0], t, t < trials, found, float(error) if t < trials and error is not None else None))
        return pd.DataFrame(rows, columns=["entity", "trial", "planted", "found", "error"])

    return series.groupBy("entity").applyInPandas(run, "entity bigint, trial int, planted boolean, found boolean, error double")


def metrics(trials: DataFrame) -> DataFrame:
    """Counts of a confusion matrix, its rates (0 without a denominator) and the median error."""
    n = {"tp": "planted and found", "fn": "planted and not found", "fp": "not planted and found", "tn": "not planted and not found"}
    c = trials.agg(*[F.count_if(F.expr(x)).alias(k) for k, x in n.items()], F.median("error").alias("median_error"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), F.lit(0.0))
    return c.withColumns({"sensitivity": rate("tp", "fn"), "specificity": rate("tn", "fp"), "precision": rate("tp", "fp"), "f1": F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))})

"""Windows in which independent signals change together, for all entities in one plan.

Every candidate start of an entity (its change points, the first similarity, the first month with a velocity) opens a
window of `days`. Three scores judge it: A, the best change point of each family of features; B, the peak of the month
velocities, the fall of the similarity to the baseline, and the rise of a reference curve where the entity has one; C,
falls of monthly model scores from the first half of the window to the second. A window is admitted by the share of
families (ratio), by A and B together (ab), or by B alone (drift_only).

Rows meet windows by entity and block of days, never by entity alone: an entity with very many rows is many blocks, and a
window reads only the blocks it covers.

Defined results: an entity without a signal scores 0 in it; C is null where the entity has no model scores at all. Equal
scores within a family take the earlier change point, then the smaller feature name. Null dates and values are left out;
duplicate rows of a month count once per row. Extra columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """The published defaults."""

    days: int = 90
    least_ratio: float = 0.5
    pass_score: float = 0.3
    drift_only: float = 0.3
    drop_epsilon: float = 0.05
    curve_divisor: float = 0.5
    curve_single: float = 0.25
    perplexity_drop: float = 0.92
    burstiness_drop: float = 0.94
    percentile: bool = False


def candidate_starts(points: DataFrame, velocities: DataFrame, similarity: DataFrame, days: int) -> DataFrame:
    """entity, start, stop: the distinct candidate windows."""
    first = lambda df, c: df.filter(F.col(c).isNotNull()).groupBy("entity").agg(F.min(c).alias("start"))
    starts = points.select("entity", F.col("day").alias("start")).filter("start is not null").unionByName(first(similarity, "day")).unionByName(first(velocities, "month"))
    return starts.distinct().withColumn("stop", F.date_add("start", days))


def _within(windows: DataFrame, rows: DataFrame, at: str, days: int, before: int = 0) -> DataFrame:
    """Windows with the rows of their entity at start - before .. stop, by blocks of `days`."""
    block = lambda d: F.floor(F.unix_date(d) / days)
    w = windows.withColumn("_block", F.explode(F.sequence(block(F.date_sub("start", before)), block(F.col("stop")))))
    r = rows.filter(F.col(at).isNotNull()).withColumn("_block", block(F.col(at)))
    return w.join(r, ["entity", "_block"]).filter(F.col(at).between(F.date_sub("start", before), F.col("stop"))).drop("_block")


def _months(windows: DataFrame, rows: DataFrame, days: int) -> DataFrame:
    """Windows with the months of their entity that they touch; `month` is the first day."""
    return _within(windows, rows, "month", days, 31).filter(F.last_day("month") >= F.col("start"))


def _clip(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


KEY = ["entity", "start", "stop"]


def stylometry(windows: DataFrame, points: DataFrame, axes: DataFrame, t: Thresholds) -> DataFrame:
    """Score A: one vote per family. points: entity, day, feature, family, strength, d; axes: entity, axes (eligible families)."""
    met = _within(windows, points.filter(F.col("family").isNotNull()), "day", t.days).withColumn("score", F.least(F.lit(1.0), F.col("strength") * F.abs("d")))
    best = met.groupBy(*KEY, "family").agg(F.max("score").alias("score"), F.min_by("feature", F.struct((-F.col("score")).alias("s"), "day", "feature")).alias("feature"), F.count("*").alias("n"))
    out = best.groupBy(*KEY).agg(F.avg("score").alias("a"), F.count("*").alias("families"), F.array_join(F.array_sort(F.collect_list("family")), ",").alias("converging"), F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("features"), F.sum("n").alias("points"))
    return out.join(axes, "entity", "left").select(*KEY, "a", F.try_divide(F.col("families"), F.col("axes")).alias("ratio"), "converging", "features", "points")


def velocity_peak(windows: DataFrame, velocities: DataFrame, t: Thresholds) -> DataFrame:
    """The window's largest velocity against the entity's own months: half its excess in deviations, or its share of months below."""
    own = Window.partitionBy("entity")
    v = velocities.filter(F.col("v").isNotNull()).withColumns({"m": F.avg("v").over(own), "s": F.coalesce(F.stddev_samp("v").over(own), F.lit(0.0)), "below": F.cume_dist().over(own.orderBy("v"))})
    top = _months(windows, v, t.days).groupBy(*KEY).agg(F.max("v").alias("top"), F.first("m").alias("m"), F.first("s").alias("s"), F.max("below").alias("below"))
    legacy = F.when(F.col("s") > 1e-12, _clip((F.col("top") - F.col("m")) / (2 * F.col("s") + 1e-12))).when(F.col("top") > F.col("m") + 2 * F.col("s"), 1.0).otherwise(0.0)
    return top.select(*KEY, (F.col("below") if t.percentile else legacy).alias("peak"))


def similarity_drop(windows: DataFrame, similarity: DataFrame, t: Thresholds) -> DataFrame:
    """How far the last third of the window's similarities lies under the first third, relative to the first."""
    s = similarity.filter(F.col("s").isNotNull()).withColumn("sd", F.coalesce(F.stddev_samp("s").over(Window.partitionBy("entity")), F.lit(0.0)))
    met = _within(windows, s, "day", t.days)
    w = Window.partitionBy(*KEY)
    met = met.withColumns({"i": F.row_number().over(w.orderBy("day", "s")), "n": F.count("*").over(w)}).withColumn("k", F.greatest(F.lit(1), F.expr("n div 3")))
    ends = met.filter("n >= 2").groupBy(*KEY).agg(F.avg(F.when(F.col("i") <= F.col("k"), F.col("s"))).alias("head"), F.avg(F.when(F.col("i") > F.col("n") - F.col("k"), F.col("s"))).alias("tail"), F.first("sd").alias("sd"))
    eps = F.greatest(F.lit(t.drop_epsilon), 0.1 * F.col("sd")) if t.percentile else F.lit(t.drop_epsilon)
    return ends.select(*KEY, _clip((F.col("head") - F.col("tail")) / (F.abs("head") + eps)).alias("drop"))


def curve_rise(windows: DataFrame, velocities: DataFrame, curve: DataFrame, t: Thresholds) -> DataFrame:
    """Rise of a monthly reference curve over the window, in the months that have a velocity too."""
    c = curve.filter(F.col("v").isNotNull()).join(velocities.select("entity", "month").distinct(), ["entity", "month"], "left_semi")
    rise = _months(windows, c, t.days).groupBy(*KEY).agg(F.min_by("v", "month").alias("a"), F.max_by("v", "month").alias("b"), F.count("*").alias("n"))
    return rise.select(*KEY, F.when(F.col("n") == 1, t.curve_single).otherwise(_clip((F.col("b") - F.col("a")) / t.curve_divisor)).alias("rise"))


def halves_drop(values: Column, ratio: float) -> Column:
    """1 for a strong fall from the first half's mean to the second's, 0.5 for a mild one, else 0; under two values 0."""
    n = F.size(values)
    half = F.expr("1") * F.floor(n / 2).cast("int")
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    pair = F.struct(mean(F.slice(values, F.lit(1), F.greatest(half, F.lit(1)))).alias("a"), mean(F.slice(values, F.least(half + 1, F.greatest(n, F.lit(1))), n - half)).alias("b"))
    return F.when(n < 2, 0.0).otherwise(F.element_at(F.transform(F.array(pair), lambda p: F.when((p["a"] > 1e-9) & (p["b"] < p["a"] * ratio), 1.0).when((p["a"] > 1e-9) & (p["b"] < p["a"]), 0.5).otherwise(0.0)), 1))


def model_scores(windows: DataFrame, monthly: DataFrame, t: Thresholds) -> DataFrame:
    """Score C. monthly: entity, month, perplexity, burstiness, spread: mean of the parts that have two months or more.

    A window has a bounded number of months, so its values are an array.
    """
    met = _months(windows, monthly, t.days)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("month", c)))), lambda z: z[c])
    got = met.groupBy(*KEY).agg(listed("perplexity").alias("p"), listed("burstiness").alias("b"), listed("spread").alias("x"), F.stddev_samp("spread").alias("sd"))
    spread = F.least(F.lit(1.0), F.when(F.size("x") > 2, F.col("sd")).otherwise(F.abs(F.element_at("x", -1) - F.element_at("x", 1))))
    parts = F.filter(F.array(F.when(F.size("p") >= 2, halves_drop(F.col("p"), t.perplexity_drop)), F.when(F.size("b") >= 2, halves_drop(F.col("b"), t.burstiness_drop)), F.when(F.size("x") >= 2, spread)), lambda v: v.isNotNull())
    return got.select(*KEY, F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, v: s + v) / F.size(parts)).otherwise(0.0).alias("c"))


def convergence(points: DataFrame, velocities: DataFrame, similarity: DataFrame, curve: DataFrame, monthly: DataFrame, axes: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """One row per entity and candidate window, admitted or not, with its signals, scores and what admits it."""
    w = candidate_starts(points, velocities, similarity, t.days)
    has = lambda df, name: df.select("entity").distinct().withColumn(name, F.lit(True))
    out = (
        w.join(stylometry(w, points, axes, t), KEY, "left").join(velocity_peak(w, velocities, t), KEY, "left").join(similarity_drop(w, similarity, t), KEY, "left")
        .join(curve_rise(w, velocities, curve, t), KEY, "left").join(model_scores(w, monthly, t), KEY, "left").join(has(curve, "has_curve"), "entity", "left").join(has(monthly, "has_c"), "entity", "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    b = F.when(F.col("has_curve"), (zero("peak") + zero("drop") + zero("rise")) / 3).otherwise((zero("peak") + zero("drop")) / 2)
    out = out.select(*KEY, zero("a").alias("a"), zero("ratio").alias("ratio"), F.coalesce("converging", F.lit("")).alias("converging"), F.coalesce("features", F.lit("")).alias("features"), F.coalesce("points", F.lit(0).cast("long")).alias("points"), zero("peak").alias("peak"), zero("drop").alias("drop"), zero("rise").alias("rise"), b.alias("b"), F.when(F.col("has_c"), zero("c")).alias("c"))
    via = {"ratio": F.col("ratio") >= t.least_ratio, "ab": (F.col("a") > t.pass_score) & (F.col("b") > t.pass_score), "drift_only": F.col("b") >= t.drift_only}
    out = out.withColumn("via", F.concat_ws(",", *[F.when(ok, F.lit(name)) for name, ok in via.items()]))
    return out.withColumn("admitted", F.col("via") != "")

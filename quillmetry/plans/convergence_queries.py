"""Convergence windows of suppliers: monthly means of their line items as signals.

The stand-ins are plain aggregates, so that the whole of the windows' logic is checked against SQL: a change point is a
month whose mean lies half a deviation or more off the month before, the velocity is the relative move of the mean
price, the similarity a bell around the supplier's mean price, the curve the monthly discount, the model scores monthly
means of other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmetry.operators import convergence as cv
from quillmetry.plans.catalog import query
from quillmetry.sources.tables import table

SIGNALS = """
with l as (select l_suppkey as entity, cast(l_shipdate as date) as d, cast(date_trunc('month', l_shipdate) as date) as month, cast(l_quantity as double) as quantity, cast(l_extendedprice as double) as price, cast(l_discount as double) as discount, cast(l_tax as double) as tax from lineitem),
f as (select entity, 'quantity' as feature, 'volume' as family, month, quantity as v from l union all select entity, 'price', 'money', month, price from l union all select entity, 'discount', 'terms', month, discount from l union all select entity, 'tax', 'terms', month, tax from l),
m as (select entity, feature, family, month, avg(v) as v from f group by 1, 2, 3, 4),
g as (select entity, feature, stddev_samp(v) as sd from f group by 1, 2),
n as (select m.*, g.sd, m.v - lag(m.v) over (partition by m.entity, m.feature order by m.month) as step from m join g on m.entity = g.entity and m.feature = g.feature),
points as (select entity, month as day, feature, family, step / sd as d, abs(step / sd) / (abs(step / sd) + 1) as strength from n where abs(step) >= 0.5 * sd),
price as (select entity, month, v, lag(v) over (partition by entity order by month) as before from m where feature = 'price'),
velocities as (select entity, month, abs(v - before) / before as v from price where before is not null),
similarity as (select p.entity, p.month as day, exp(-power((p.v - a.v) / 10000.0, 2)) as s from m p join (select entity, avg(price) as v from l group by 1) a on p.entity = a.entity where p.feature = 'price'),
curve as (select entity, month, v * 10 as v from m where feature = 'discount' and entity % 2 = 0),
monthly as (select entity, month, avg(quantity) as perplexity, avg(tax) as burstiness, avg(discount) * 10 as spread from l where entity % 3 <> 0 group by 1, 2),
axes as (select entity, count(distinct family) as axes from f group by 1)
"""

WINDOWS = """,
w0 as (select entity, day as start from points union select entity, min(day) from similarity group by 1 union select entity, min(month) from velocities group by 1),
w as (select entity, start, cast(start + interval 90 day as date) as stop from w0),
ap as (select w.entity, w.start, p.family, p.feature, p.day, least(1.0, p.strength * abs(p.d)) as score from w join points p on p.entity = w.entity and p.day between w.start and w.stop),
ar as (select *, row_number() over (partition by entity, start, family order by score desc, day, feature) as r, count(*) over (partition by entity, start) as points from ap),
a as (select ar.entity, ar.start, avg(score) as a, count(*) / any_value(axes.axes) as ratio, string_agg(family, ',' order by family) as converging, string_agg(feature, ',' order by feature) as features, any_value(points) as points from ar join axes on axes.entity = ar.entity where r = 1 group by 1, 2),
vs as (select entity, avg(v) as m, coalesce(stddev_samp(v), 0) as s from velocities group by 1),
vt as (select w.entity, w.start, max(v.v) as top from w join velocities v on v.entity = w.entity and v.month <= w.stop and last_day(v.month) >= w.start group by 1, 2),
vp as (select vt.entity, vt.start, {peak} as peak from vt join vs on vs.entity = vt.entity),
sw as (select w.entity, w.start, s.s, row_number() over (partition by w.entity, w.start order by s.day, s.s) as i, count(*) over (partition by w.entity, w.start) as n from w join similarity s on s.entity = w.entity and s.day between w.start and w.stop),
sd as (select entity, coalesce(stddev_samp(s), 0) as sd from similarity group by 1),
se as (select entity, start, avg(s) filter (where i <= greatest(1, n // 3)) as head, avg(s) filter (where i > n - greatest(1, n // 3)) as tail from sw where n >= 2 group by 1, 2),
sp as (select se.entity, se.start, least(1.0, greatest(0.0, (head - tail) / (abs(head) + {eps}))) as fall from se join sd on sd.entity = se.entity),
cw as (select w.entity, w.start, arg_min(c.v, c.month) as x, arg_max(c.v, c.month) as y, count(*) as n from w join curve c on c.entity = w.entity and c.month <= w.stop and last_day(c.month) >= w.start join velocities v on v.entity = c.entity and v.month = c.month group by 1, 2),
cp as (select entity, start, case when n = 1 then 0.25 else least(1.0, greatest(0.0, (y - x) / 0.5)) end as rise from cw),
mw as (select w.entity, w.start, m.month, m.perplexity, m.burstiness, m.spread, row_number() over (partition by w.entity, w.start order by m.month) as i, count(*) over (partition by w.entity, w.start) as n from w join monthly m on m.entity = w.entity and m.month <= w.stop and last_day(m.month) >= w.start),
mh as (select entity, start, any_value(n) as n, avg(perplexity) filter (where i <= n // 2) as p1, avg(perplexity) filter (where i > n // 2) as p2, avg(burstiness) filter (where i <= n // 2) as b1, avg(burstiness) filter (where i > n // 2) as b2, stddev_samp(spread) as sd, abs(arg_max(spread, month) - arg_min(spread, month)) as gap from mw group by 1, 2),
mc as (select entity, start, case when n < 2 then 0.0 else ((case when p1 > 1e-9 and p2 < p1 * 0.92 then 1.0 when p1 > 1e-9 and p2 < p1 then 0.5 else 0.0 end) + (case when b1 > 1e-9 and b2 < b1 * 0.94 then 1.0 when b1 > 1e-9 and b2 < b1 then 0.5 else 0.0 end) + least(1.0, case when n > 2 then sd else gap end)) / 3.0 end as c from mh),
o as (select w.entity, w.start, w.stop, coalesce(a.a, 0.0) as a, coalesce(a.ratio, 0.0) as ratio, coalesce(a.converging, '') as converging, coalesce(a.features, '') as features, coalesce(a.points, 0) as points, coalesce(vp.peak, 0.0) as peak, coalesce(sp.fall, 0.0) as drop_, coalesce(cp.rise, 0.0) as rise, (coalesce(vp.peak, 0.0) + coalesce(sp.fall, 0.0) + case when w.entity in (select entity from curve) then coalesce(cp.rise, 0.0) else 0.0 end) / (case when w.entity in (select entity from curve) then 3 else 2 end) as b, case when w.entity in (select entity from monthly) then coalesce(mc.c, 0.0) end as c
 from w left join a on a.entity = w.entity and a.start = w.start left join vp on vp.entity = w.entity and vp.start = w.start left join sp on sp.entity = w.entity and sp.start = w.start left join cp on cp.entity = w.entity and cp.start = w.start left join mc on mc.entity = w.entity and mc.start = w.start),
z as (select *, concat_ws(',', case when ratio >= 0.5 then 'ratio' end, case when a > 0.3 and b > 0.3 then 'ab' end, case when b >= 0.3 then 'drift_only' end) as via from o)
"""
LEGACY = WINDOWS.format(peak="case when vs.s > 1e-12 then least(1.0, greatest(0.0, (top - m) / (2 * vs.s + 1e-12))) when top > m + 2 * vs.s then 1.0 else 0.0 end", eps="0.05")
RANKED = WINDOWS.format(peak="(select count(*) from velocities x where x.entity = vt.entity and x.v <= vt.top) / (select count(*) from velocities x where x.entity = vt.entity)", eps="greatest(0.05, 0.1 * sd.sd)")


def signals(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """points, velocities, similarity, curve, monthly and axes of the suppliers."""
    lines = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return {name: spark.sql(SIGNALS.replace("from lineitem", "from {lineitem}") + f"select * from {name}", lineitem=lines) for name in ("points", "velocities", "similarity", "curve", "monthly", "axes")}


def _windows(spark: SparkSession, sf_dir: str, t: cv.Thresholds = cv.Thresholds()) -> DataFrame:
    return cv.convergence(**signals(spark, sf_dir), t=t)


@query("convergence_components", SIGNALS + LEGACY + "select entity, start, stop, a, ratio, converging, features, points, peak, drop_, rise, b, c, via from z")
def convergence_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate window with all its signals and scores, admitted or not."""
    return _windows(spark, sf_dir).withColumnRenamed("drop", "drop_").drop("admitted")


@query("convergence_windows", SIGNALS + LEGACY + "select entity, start, stop, converging, ratio, a, b, c, via from z where via <> ''")
def convergence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The admitted windows."""
    return _windows(spark, sf_dir).filter("admitted").select("entity", "start", "stop", "converging", "ratio", "a", "b", "c", "via")


@query("convergence_percentile", SIGNALS + RANKED + "select entity, start, peak, drop_, b, via from z")
def convergence_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows with the peak as a percentile of the entity's own months and the floor of its own spread."""
    return _windows(spark, sf_dir, cv.Thresholds(percentile=True)).select("entity", "start", "peak", F.col("drop").alias("drop_"), "b", "via")


@query("pipeline_c_mean", SIGNALS + LEGACY + "select entity, avg(c) as c, count(c) as windows from z where via <> '' group by 1")
def pipeline_c_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the model scores of an entity's admitted windows; windows without one don't count."""
    return _windows(spark, sf_dir).filter("admitted").groupBy("entity").agg(F.avg("c").alias("c"), F.count("c").alias("windows"))


@query("windows_by_entity", SIGNALS + LEGACY + "select x.entity, count(z.entity) as windows from axes x left join z on z.entity = x.entity and z.via <> '' group by 1 having count(z.entity) > 0 or x.entity in (select entity from points) or x.entity in (1, 2)")
def windows_by_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities to look at again: with a change point or a window, or on a list (here 1 and 2), and their windows."""
    s = signals(spark, sf_dir)
    n = cv.convergence(**s).filter("admitted").groupBy("entity").agg(F.count("*").alias("windows"))
    chosen = s["points"].select("entity").union(n.select("entity")).union(s["axes"].filter("entity in (1, 2)").select("entity")).distinct()
    return s["axes"].select("entity").join(chosen, "entity", "left_semi").join(n, "entity", "left").select("entity", F.coalesce("windows", F.lit(0).cast("long")).alias("windows"))


@query("tests_per_family", SIGNALS + "select entity, count(distinct feature) as features, count(distinct family) as families from points group by 1")
def tests_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir)["points"].groupBy("entity").agg(F.count_distinct("feature").alias("features"), F.count_distinct("family").alias("families"))


@query("best_test_per_feature", SIGNALS + "select entity, feature, day, d from (select *, row_number() over (partition by entity, feature order by abs(d) desc, day) as r from points) x where r = 1")
def best_test_per_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each entity and feature the change of the largest effect, ties to the earliest."""
    return signals(spark, sf_dir)["points"].groupBy("entity", "feature").agg(F.min_by(F.struct("day", "d"), F.struct((-F.abs("d")).alias("x"), "day")).alias("b")).select("entity", "feature", "b.day", "b.d")

"""Analysis of suppliers' line items as feature series: changes, tests, gates, profiles, contrasts, reports, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmetry.operators import analysis as an
from quillmetry.operators import changepoints as cp
from quillmetry.operators import convergence as cv
from quillmetry.operators import ranks
from quillmetry.plans.catalog import ORACLE, QUERIES, query
from quillmetry.plans.convergence_queries import LEGACY, SIGNALS, signals
from quillmetry.runtime import shared_folder, written
from quillmetry.sources import artifacts as art
from quillmetry.sources.tables import table

FEATURES = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
FAMILIES = {"quantity": "volume", "price": "money", "discount": "terms", "tax": "terms", "day": "time"}
TIES = ["l_orderkey", "l_linenumber", "l_partkey"]


def _long(spark: SparkSession, sf_dir: str, features: dict[str, str] = FEATURES) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return an.long_form(lines, "l_suppkey", "l_shipdate", TIES, features, "l_returnflag")


LONG_SQL = "select l_suppkey as entity, l_shipdate as ts, l_orderkey as a, l_linenumber as b, l_partkey as c, l_returnflag as section, unnest(['quantity', 'price', 'discount', 'tax']) as feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as value from lineitem"


@query("feature_changes")
def feature_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks of every feature of every supplier by both methods, of the values and of the values less their section's part."""
    long = _long(spark, sf_dir)
    return an.changes(long).unionByName(an.changes(an.residualised(long), suffix="_section_adjusted"))


@query("rolling_long", f"with x as ({LONG_SQL}) select entity, a, b, c, feature, value, avg(value) over w30 as mean_30, coalesce(stddev_samp(value) over w30, 0) as std_30, avg(value) over w90 as mean_90, coalesce(stddev_samp(value) over w90, 0) as std_90 from x window w30 as (partition by entity, feature order by ts, a, b, c rows between 29 preceding and current row), w90 as (partition by entity, feature order by ts, a, b, c rows between 89 preceding and current row)")
def rolling_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long table of all features with their rolling means and deviations over 30 and 90 rows."""
    out = an.rolling(_long(spark, sf_dir))
    return out.select("entity", F.col("tie.l_orderkey").alias("a"), F.col("tie.l_linenumber").alias("b"), F.col("tie.l_partkey").alias("c"), "feature", "value", "mean_30", "std_30", "mean_90", "std_90")


@query("feature_components")
def feature_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend, seasonal part and rest of every feature of every supplier."""
    return an.decomposed(_long(spark, sf_dir))


RESIDUAL_SQL = f"with x as ({LONG_SQL}), g as (select entity, feature, section, count(value) as n, avg(value) as m from x group by all), e as (select entity, feature, count(*) filter (where n >= 10) as k from g group by all), o as (select entity, feature, avg(value) as m from x group by all) select x.entity, x.a, x.b, x.c, x.feature, case when e.k >= 2 and g.n >= 10 then x.value - g.m + o.m else x.value end as value from x join g using (entity, feature, section) join e using (entity, feature) join o using (entity, feature)"


@query("residualised_long", RESIDUAL_SQL)
def residualised_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.residualised(_long(spark, sf_dir)).select("entity", F.col("tie.l_orderkey").alias("a"), F.col("tie.l_linenumber").alias("b"), F.col("tie.l_partkey").alias("c"), "feature", "value")


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir)
    tests = written(an.tests_at(long, an.changes(long)), "tests")
    return tests.withColumn("id", F.concat_ws("/", "entity", "feature", "method", "at", "test"))


@query("tests_at_breaks")
def tests_at_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-sample tests at every detected break."""
    return _tested(spark, sf_dir)


@query("gated_tests")
def gated_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those tests after one correction over all suppliers, the second pass across suppliers, and the gate of effects."""
    family = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    tests = an.gated(_tested(spark, sf_dir), "id").withColumn("family", family[F.col("feature")])
    return an.across_entities(tests, "entity", "family")


GATE_SQL = """
with t as (select event_id, user_id, event_type as fam, cast((event_id % 997 + 1) / 1000.0 as double) / 40 as p, (value - 50) / 40 as d, case when event_id % 17 = 0 then 'short_segment' end as skipped, event_id % 23 = 0 as degenerate from events),
r as (select *, row_number() over (order by p, event_id) as rk, count(*) over () as n from t where skipped is null and not degenerate),
q as (select event_id, least(1.0, min(p * n / rk) over (order by rk desc rows between unbounded preceding and current row)) as q from r)
"""


def _pseudo_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "value"]).select(
        "event_id", "user_id", F.col("event_type").alias("fam"), F.expr("cast((event_id % 997 + 1) / 1000.0 as double) / 40").alias("p"), ((F.col("value") - 50) / 40).alias("d"),
        F.when(F.col("event_id") % 17 == 0, "short_segment").alias("skipped"), (F.col("event_id") % 23 == 0).alias("degenerate"),
    )


@query("global_gate", GATE_SQL + "select t.event_id, q.q, coalesce(q.q < 0.05 and abs(t.d) >= 0.5, false) as significant from t left join q on q.event_id = t.event_id")
def global_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One correction over the tests that can be ranked, then the gate of effects; the others keep their rows."""
    return an.gated(_pseudo_tests(spark, sf_dir), "event_id").select("event_id", "q", "significant")


@query("stamped_second_pass", GATE_SQL + ", m as (select user_id, fam, min(q.q) as p from t join q on q.event_id = t.event_id group by all), s as (select *, row_number() over (partition by fam order by p, user_id) as rk, count(*) over (partition by fam) as n from m), z as (select user_id, fam, n, least(1.0, min(p * n / rk) over (partition by fam order by rk desc rows between unbounded preceding and current row)) as q2 from s) select t.event_id, case when z.n = 1 then q.q when q.q is not null then greatest(q.q, z.q2) else z.q2 end as q_across, case when z.n = 1 then 'single_entity' end as reason from t left join q on q.event_id = t.event_id left join z on z.user_id = t.user_id and z.fam = t.fam")
def stamped_second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's smallest corrected p per family, corrected over the users and stamped on all its rows."""
    return an.across_entities(an.gated(_pseudo_tests(spark, sf_dir), "event_id"), "user_id", "fam").select("event_id", "q_across", "reason")


@query("significance_rates", GATE_SQL + ", g as (select t.user_id, t.fam, coalesce(q.q < 0.05 and abs(t.d) >= 0.5, false) as s from t left join q on q.event_id = t.event_id), u as (select 'family' as kind, fam as name, count(*) as n, count(*) filter (where s) as hits from g group by fam union all select * from (select 'user', cast(user_id as varchar), count(*), count(*) filter (where s) as hits from g group by user_id order by hits desc, cast(user_id as varchar) limit 20) x) select kind, name, n, hits, 100.0 * hits / n as percent from u")
def significance_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Significant tests by family, and of the twenty users that have most."""
    g = an.gated(_pseudo_tests(spark, sf_dir), "event_id")
    by = lambda kind, c: g.groupBy(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("name")).agg(F.count("*").alias("n"), F.count_if("significant").alias("hits"))
    return by("family", "fam").unionByName(by("user", "user_id").orderBy(F.desc("hits"), "name").limit(20)).withColumn("percent", 100.0 * F.col("hits") / F.col("n").cast("double"))


@query("clamped_p", "select event_id, case when value is null or isnan(value) or isinf(value) then 1.0 else least(1.0, greatest(0.0, value / 50 - 0.5)) end as p from events")
def clamped_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", ["event_id", "value"]).select("event_id", an.clamp_p(F.col("value") / 50 - 0.5).alias("p"))


@query("p_values")
def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p beside the statistics: Welch, ranks, omnibus over sections, and one trend against two."""
    q = {name: QUERIES[name](spark, sf_dir) for name in ("welch_t", "mann_whitney_u", "kruskal_h", "chow_f")}
    row = lambda name, key, stat, p: q[name].select(F.col(key).alias("entity"), F.lit(name).alias("test"), F.col(stat).alias("statistic"), p.alias("p"))
    n = table(spark, sf_dir, "events", ["user_id", "event_type"]).groupBy(F.col("user_id").alias("k")).agg(F.count_distinct("event_type").alias("groups"), F.count("*").alias("n"))
    q["kruskal_h"] = q["kruskal_h"].join(n, "k")
    q["chow_f"] = q["chow_f"].join(n.withColumnRenamed("k", "user_id"), "user_id")
    return (
        row("welch_t", "k", "t", an.t_p("t", "df")).unionByName(row("mann_whitney_u", "k", "u", an.normal_p("z")))
        .unionByName(row("kruskal_h", "k", "h", an.chi2_p("h", (F.col("groups") - 1).cast("double")))).unionByName(row("chow_f", "user_id", "f", an.f_p("f", F.lit(2.0), (F.col("n") - 4).cast("double"))))
    )


PROFILED = FEATURES | {"day": "datediff(cast(l_shipdate as date), date'1970-01-01') / 1000.0"}
PROFILE_SQL = """
with x as (select l_suppkey as entity, coalesce(l_returnflag, 'unknown') as section, unnest(['quantity', 'price', 'discount', 'tax', 'day']) as feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax, epoch(cast(l_shipdate as date)) / 86400.0 / 1000.0]) as value from lineitem),
k as (select section, count(*) as n from x where feature = 'tax' group by 1 having count(*) >= 30 and count(distinct entity) >= 2),
y as (select x.* from x join k using (section)),
r as (select feature, section, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0 as rk, count(*) over (partition by feature, value) as t, count(*) over (partition by feature) as n from y),
g as (select feature, section, cast(count(*) as double) as c, cast(any_value(n) as double) as n, sum(rk) as s, sum(cast(t as double) * t - 1) as ties from r group by 1, 2),
h as (select feature, any_value(n) as n, count(*) as k, (12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / c) - 3 * (any_value(n) + 1)) / (1 - sum(ties) / (power(any_value(n), 3) - any_value(n))) as h from g group by 1),
f as (select distinct case feature when 'quantity' then 'volume' when 'price' then 'money' when 'day' then 'time' else 'terms' end as family from h where h > case k when 2 then 6.6348966 when 3 then 9.2103404 when 4 then 11.3448667 else 13.2767041 end),
m as (select section, feature, avg(value) as m from y group by 1, 2),
v as (select section, list(m order by feature) as v from m group by 1),
d as (select max(1 - list_cosine_similarity(a.v, b.v)) as far from v a join v b on a.section < b.section)
"""


@query("section_profile", PROFILE_SQL + "select (select count(*) from k) as sections, (select coalesce(string_agg(family, ',' order by family), '') from f) as families, (select count(*) from f) as n_families, coalesce((select far from d), 0) as max_distance, case when (select count(*) from k) < 2 then 'DEGENERATE' else ['FAIL', 'BORDERLINE', 'PASS'][1 + cast((select count(*) from f) >= 3 as int) + cast(coalesce((select far from d), 0) > 0.3 as int)] end as verdict")
def section_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether sections differ enough to take them out of the series: sections kept, families that differ, distance, verdict."""
    return an.profile(_long(spark, sf_dir, PROFILED), FAMILIES)


@query("features_by_effect", PROFILE_SQL + "select feature, h, k, cast(n as bigint) as n, greatest(0, least(1, (h - k + 1) / (n - k))) as eta, row_number() over (order by greatest(0, least(1, (h - k + 1) / (n - k))) desc, feature) as place from h")
def features_by_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by how much of their ranks the sections explain, ties in their order. The features are a short list."""
    long = _long(spark, sf_dir, PROFILED)
    out = an.kruskal(long, an.retained_sections(long)).select("feature", "h", "k", "n", "eta")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("eta"), "feature")))


@query("section_contrast")
def section_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells the sections of each supplier apart, by family."""
    return an.contrast(_long(spark, sf_dir, PROFILED), FAMILIES)


@query("contrast_table")
def contrast_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contrasts as a table for reports: a row per supplier and pair, a column per family."""
    c = an.contrast(_long(spark, sf_dir, PROFILED), FAMILIES)
    return c.groupBy("entity", "a", "b").pivot("family", sorted(set(FAMILIES.values()))).agg(F.first("features")).na.fill("")


@query("label_permutation")
def label_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest share of distinct features in a supplier's windows against shuffled labels."""
    s = signals(spark, sf_dir)
    return an.label_permutation(s["points"], cv.candidate_starts(s["points"], s["velocities"], s["similarity"], 90), len(FEATURES))


@query("trajectories", "with m as (select o_custkey as k, cast(date_trunc('month', o_orderdate) as date) as month, avg(o_totalprice) as a from orders where o_orderstatus = 'F' group by 1, 2), n as (select o_custkey as k, cast(date_trunc('month', o_orderdate) as date) as month, avg(o_totalprice) as b from orders where o_orderpriority like '1%' group by 1, 2), o as (select distinct o_custkey as k, cast(date_trunc('month', o_orderdate) as date) as month from orders) select o.k, o.month, coalesce(m.a, n.b) as score, case when m.a is not null then 'features' when n.b is not null then 'scores' end as origin from o left join m using (k, month) left join n using (k, month)")
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly scores of each entity from the feature table, and where it has none from the table of scores."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("month"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    monthly = lambda rows, name: rows.groupBy("k", "month").agg(F.avg("o_totalprice").alias(name))
    out = o.select("k", "month").distinct().join(monthly(o.filter("o_orderstatus = 'F'"), "a"), ["k", "month"], "left").join(monthly(o.filter("o_orderpriority like '1%'"), "b"), ["k", "month"], "left")
    return out.select("k", "month", F.coalesce("a", "b").alias("score"), F.when(F.col("a").isNotNull(), "features").when(F.col("b").isNotNull(), "scores").alias("origin"))


@query("admissible_evidence", SIGNALS + "select entity, day, feature, d from points where family in ('terms', 'money') and d > 0 and day >= date '1996-01-01' and day < (select max(day) from points) - interval 30 day")
def admissible_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Increases in the families that count, from a date on and not among the last thirty days."""
    p = signals(spark, sf_dir)["points"]
    last = p.agg(F.date_sub(F.max("day"), 30).alias("tail"))
    return p.join(F.broadcast(last), F.col("day") < F.col("tail")).filter("family in ('terms', 'money') and d > 0 and day >= date'1996-01-01'").select("entity", "day", "feature", "d")


@query("narratives", SIGNALS + LEGACY + ", nn as (select entity, count(*) as n, arg_min(start, (-ratio, start)) as best, max(ratio) as ratio from z where via <> '' group by 1) select x.entity, case when nn.n is null then 'Supplier ' || x.entity || ': no window of converging signals.' else 'Supplier ' || x.entity || ': ' || nn.n || ' windows of converging signals, the widest from ' || strftime(nn.best, '%Y-%m-%d') || ' with ' || printf('%.0f', nn.ratio * 100) || ' % of the families.' end as text from axes x left join nn on nn.entity = x.entity")
def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence per supplier from its windows."""
    s = signals(spark, sf_dir)
    a = cv.convergence(**s).filter("admitted").groupBy("entity").agg(F.count("*").alias("n"), F.min_by("start", F.struct((-F.col("ratio")).alias("r"), "start")).alias("best"), F.max("ratio").alias("ratio"))
    none = F.format_string("Supplier %s: no window of converging signals.", F.col("entity"))
    some = F.format_string("Supplier %s: %s windows of converging signals, the widest from %s with %.0f %% of the families.", "entity", "n", F.date_format("best", "yyyy-MM-dd"), F.col("ratio") * 100)
    return s["axes"].select("entity").join(a, "entity", "left").select("entity", F.when(F.col("n").isNull(), none).otherwise(some).alias("text"))


@query("limited_table", "select row_number() over (order by c_acctbal desc, c_custkey) as place, c_custkey, c_name, 'showing ' || least(10, count(*) over ()) || ' of ' || count(*) over () as note from customer qualify place <= 10")
def limited_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows of a report's table, with how many there are."""
    c = table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal"])
    top = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)
    n = c.agg(F.count("*").alias("n"))
    placed = top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("c_acctbal"), "c_custkey")))
    return placed.crossJoin(F.broadcast(n)).select("place", "c_custkey", "c_name", F.format_string("showing %d of %d", F.least(F.lit(10).cast("long"), "n"), "n").alias("note"))


@query("recent_peers", "with d as (select doc_id, source, published_at from documents where source is not null and published_at is not null) select doc_id, count(*) over w as peers, coalesce(sum(doc_id) over w, 0) as id_sum from d window w as (partition by source order by published_at, doc_id rows between 48 preceding and 1 preceding)")
def recent_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 48 documents of the same source before each one: how many there are, and the sum of their ids."""
    d = table(spark, sf_dir, "documents", ["doc_id", "source", "published_at"]).filter("source is not null and published_at is not null")
    w = Window.partitionBy("source").orderBy("published_at", "doc_id").rowsBetween(-48, -1)
    return d.select("doc_id", F.count("*").over(w).alias("peers"), F.coalesce(F.sum("doc_id").over(w), F.lit(0)).alias("id_sum"))


@query("halves_drop", "with m as (select o_custkey as k, date_trunc('month', o_orderdate) as month, avg(o_totalprice) as v from orders group by 1, 2), r as (select *, row_number() over (partition by k order by month) as i, count(*) over (partition by k) as n from m), h as (select k, any_value(n) as n, avg(v) filter (where i <= n // 2) as a, avg(v) filter (where i > n // 2) as b from r group by 1) select k, cast(case when n < 2 then 0 when a > 1e-9 and b < a * 0.92 then 1 when a > 1e-9 and b < a then 0.5 else 0 end as double) as score from h")
def halves_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each entity's monthly means fall from the first half to the second: 1, 0.5 or 0."""
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.date_trunc("MONTH", "o_orderdate").alias("month")).agg(F.avg("o_totalprice").alias("v"))
    listed = m.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "v"))), lambda z: z["v"]).alias("v"))
    return listed.select("k", cv.halves_drop(F.col("v"), 0.92).alias("score"))


@query("drift_cached", ORACLE.get("drift_summary"))
def drift_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift summary under the hash of its configuration and data: made and stored the first time, loaded the second."""
    data = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("vec_id", "label", "embedding")).alias("x")).first()
    config = art.config_hash({"of": "drift_summary", "data": [data.n, data.x]})
    folder = f"{shared_folder(spark)}/drift-{config}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder + "/_SUCCESS")
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        QUERIES["drift_summary"](spark, sf_dir).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


@query("calibration_run")
def calibration_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well planted shifts are found and shuffled series left alone: counts, rates, median error of place."""
    long = _long(spark, sf_dir, {"quantity": "l_quantity"})
    series = long.select("entity", F.row_number().over(Window.partitionBy("entity").orderBy("ts", "tie")).alias("i"), "value")
    return an.metrics(an.calibration(series))


@query("changepoint_stage")
def changepoint_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage of changes alone: values imputed, changes, those that pass the gate of evidence, and windows by supplier."""
    long = _long(spark, sf_dir)
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    imputed = long.groupBy("entity").agg(F.count_if(bad).alias("imputed"))
    found = written(an.changes(long), "changes")
    passed = cp.evidence_gate(found.filter("method = 'pelt'"), "pelt").unionByName(cp.evidence_gate(found.filter("method <> 'pelt'"), "bocpd"))
    family = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    points = passed.select("entity", F.col("ts").cast("date").alias("day"), "feature", family[F.col("feature")].alias("family"), "d", F.col("confidence").alias("strength"))
    none = {k: v.limit(0) for k, v in signals(spark, sf_dir).items() if k not in ("points", "axes")}
    windows = cv.convergence(points=points, axes=signals(spark, sf_dir)["axes"], **none).filter("admitted")
    out = imputed
    for name, rows in (("changes", found), ("passed", passed), ("windows", windows)):
        out = out.join(rows.groupBy("entity").agg(F.count("*").alias(name)), "entity", "left")
    return out.na.fill(0)


@query("entity_analysis")
def entity_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages for all suppliers at once: changes, tests, gates, windows; one row each, ranked by what was found.

    Suppliers with fewer than fifty rows don't qualify; those in the table of finished ones (here: ids divisible by 10)
    are skipped, as a resumed run does.
    """
    long = _long(spark, sf_dir)
    enough = long.groupBy("entity").agg((F.count("*") / len(FEATURES)).alias("n")).filter("n >= 50").select("entity")
    finished = enough.filter("entity % 10 = 0")
    entities = written(enough.join(finished, "entity", "left_anti"), "entities")
    long = long.join(entities, "entity", "left_semi")
    found = written(an.changes(long), "changes")
    tests = an.gated(written(an.tests_at(long, found), "tests").withColumn("id", F.concat_ws("/", "entity", "feature", "method", "at", "test")), "id")
    significant = written(tests.filter("significant").groupBy("entity").agg(F.count("*").alias("significant")), "significant")
    family = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    points = found.select("entity", F.col("ts").cast("date").alias("day"), "feature", family[F.col("feature")].alias("family"), "d", F.col("confidence").alias("strength"))
    s = {k: v.join(entities, "entity", "left_semi") for k, v in signals(spark, sf_dir).items() if k != "points"}
    windows = cv.convergence(points=points, **s).filter("admitted").groupBy("entity").agg(F.count("*").alias("windows"), F.max(F.least("a", "b")).alias("best"))
    by = entities
    for rows in (found.groupBy("entity").agg(F.count("*").alias("changes")), significant, written(windows, "windows")):
        by = by.join(rows, "entity", "left")
    by = by.na.fill(0, ["changes", "significant", "windows"]).withColumn("best", F.coalesce("best", F.lit(0.0)))
    return ranks.ranked(by, [F.desc("significant"), F.desc("windows"), F.desc("best"), F.col("entity")], rank="place", total="entities").drop("_range")

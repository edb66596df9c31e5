"""Scans, filters, joins, aggregates, windows and set operations over series and dimensions.

Roles of the tables: orders are a series of values per customer over eighty months, with the priority as section;
events are a dense series per user; customer, nation and region are the dimensions; articles and authors the corpus.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmetry.operators import ranks
from quillmetry.plans.catalog import query
from quillmetry.plans.dialect import both, spelled
from quillmetry.plans.dialect import rounded as R
from quillmetry.sources.tables import table

ORD = "partition by o_custkey order by o_orderdate, o_orderkey"
EV = "partition by user_id order by ts, event_id"


@both("monthly_feature_stats", "orders")
def _(d):
    """Mean, sample deviation and count per month."""
    return f"select {d.month('o_orderdate')} as month, {R('avg(o_totalprice)')} as mean, {R('stddev_samp(o_totalprice)')} as std, count(*) as n from {d.t('orders')} group by 1"


@both("rolling_feature_comparison", "events", "customer")
def _(d):
    """Rolling mean over rows per entity, joined with the dimension."""
    return f"select c.c_name as name, e.event_id, {R(f'avg(e.value) over (partition by e.user_id order by e.ts, e.event_id rows between 89 preceding and current row)')} as rolling from {d.t('events')} e join {d.t('customer')} c on e.user_id = c.c_custkey"


@both("marker_spike_detection", "orders")
def _(d):
    """Months whose mean lies two deviations over the mean of the months."""
    return f"with m as (select {d.month_key('o_orderdate')} as month, avg(o_totalprice) as mean from {d.t('orders')} group by 1), s as (select avg(mean) as grand, stddev_samp(mean) as dev from m) select m.month, {R('m.mean')} as mean, m.mean > s.grand + 2 * coalesce(s.dev, 0) as spike from m cross join s"


@both("point_lookup", "customer")
def _(d):
    return f"select c_custkey, c_name, c_acctbal from {d.t('customer')} where c_custkey = 42"


@both("batch_lookup", "customer")
def _(d):
    return f"select c_custkey, c_name from {d.t('customer')} where c_mktsegment in ('BUILDING', 'MACHINERY')"


@both("rows_that_exist", "articles")
def _(d):
    """Articles of the authors that have a flagged one: an existence probe as a semi join."""
    return f"select author_id, count(*) as articles from (select distinct id, author_id from {d.t('articles')}) a where author_id in (select author_id from {d.t('articles')} where is_duplicate) group by 1"


@both("eligible_articles", "articles")
def _(d):
    """Rows fit for extraction: a body, no stub of a redirect, no flag, fifty words."""
    return f"select id, author_id, word_count from (select distinct id, author_id, word_count, clean_text, is_duplicate from {d.t('articles')}) a where trim(coalesce(clean_text, '')) <> '' and clean_text not like '[REDIRECT:%' and not is_duplicate and word_count >= 50"


@both("dedup_source", "articles")
def _(d):
    return f"select id, {d.sha('clean_text')} as digest from (select distinct id, clean_text from {d.t('articles')}) a where clean_text is not null and clean_text <> '' and clean_text not like '[REDIRECT:%'"


@both("unfetched_articles", "articles", "authors")
def _(d):
    """Articles whose page was never stored, with the author's name."""
    return f"select a.id, u.name from (select distinct id, author_id, raw_html_path from {d.t('articles')}) a join {d.t('authors')} u on a.author_id = u.id where coalesce(a.raw_html_path, '') = ''"


@both("upsert_last_wins", "orders")
def _(d):
    """The last row per key of a base and its deltas."""
    return f"with x as (select o_custkey as k, o_totalprice as v, o_orderdate as at, o_orderkey as tie, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from {d.t('orders')}) select k, v, tie from x where r = 1"


@both("duplicate_flags", "articles")
def _(d):
    """All flags cleared, then set where an earlier id has the same content hash."""
    return f"with x as (select distinct id, content_hash from {d.t('articles')}) select id, case when content_hash is null then false else row_number() over (partition by content_hash order by id) > 1 end as is_duplicate from x"


@both("archive_paths", "articles")
def _(d):
    """Paths rewritten to their archived form; unsafe tails are left as they are."""
    safe = d.like("raw_html_path", r"^raw/[0-9][0-9][0-9][0-9]/[A-Za-z0-9._-]+$")
    return f"select distinct id, case when {safe} then concat(substr(raw_html_path, 1, 8), '.tar.gz:', substr(raw_html_path, 10)) else raw_html_path end as path from {d.t('articles')}"


@both("export_counts", "articles", "authors", "documents", "generated_articles")
def _(d):
    return " union all ".join(f"select '{t}' as name, count(*) as n from {d.t(t)}" for t in ("articles", "authors", "documents", "generated_articles"))


@both("manifest_last_wins", "generated_articles")
def _(d):
    """The last record per key in generation order."""
    return f"with x as (select article_id, model, row_number() over (partition by article_id order by generated_at desc, model desc) as r from {d.t('generated_articles')}) select article_id, model from x where r = 1"


@both("column_subset", "part")
def _(d):
    return f"select p_partkey, p_retailprice from {d.t('part')} where p_size between 10 and 20"


@both("section_from_url", "articles")
def _(d):
    """First segment of a URL's path, years and missing ones as unknown, and articles per section."""
    seg = d.group("lower(coalesce(url, ''))", r"^https?://[^/]+/([a-z0-9-]+)(/|$)", 1)
    return f"with x as (select distinct id, {seg} as s from {d.t('articles')}) select case when s = '' or {d.like('s', '^[0-9][0-9][0-9][0-9]$')} then 'unknown' else s end as section, count(*) as n from x group by 1"


@both("excluded_sections", "articles")
def _(d):
    """Kept and audited rows in one pass, with the reason."""
    sec = d.group("coalesce(url, '')", r"^https?://[^/]+/([a-z0-9-]+)/", 1)
    return f"select reason, count(*) as n from (select distinct id, case when {sec} in ('sponsored', 'partner-content', 'opinion') then concat('excluded_section:', {sec}) else 'kept' end as reason from {d.t('articles')}) x group by 1"


@both("decoded_metadata", "articles")
def _(d):
    """Fields of tolerant JSON; broken documents count as empty."""
    sec = d.json("metadata", "og_section")
    return f"select coalesce({sec}, 'none') as section, count(*) as n from (select distinct id, metadata from {d.t('articles')}) x group by 1"


@both("finite_values", "events")
def _(d):
    return f"select user_id, count(*) as n, {R('avg(v)')} as mean from (select user_id, case when isnan(value) or abs(value) = cast('infinity' as double) then null else value end as v from {d.t('events')}) x group by user_id"


@both("imputation_stats", "events")
def _(d):
    """Values that are missing or not finite, per entity, and the median that stands in for them."""
    return f"select user_id, count(*) as n, count(case when value is null or isnan(value) then 1 end) as missing, {R('median(value)')} as fill from {d.t('events')} group by user_id"


@both("coverage_diagnostics", "events")
def _(d):
    return f"select event_type, case when count(value) = 0 then 'all_null' when max(abs(value)) = 0 then 'all_zero' else 'ok' end as state, count(distinct user_id) as entities from {d.t('events')} group by event_type"


@both("section_retention", "orders")
def _(d):
    """Sections kept or skipped, with the reason, by rows and distinct entities."""
    return f"select o_orderpriority as section, count(*) as n, count(distinct o_custkey) as entities, case when count(*) < 30 then 'too_few_rows' when count(distinct o_custkey) < 2 then 'single_entity' else 'kept' end as reason from {d.t('orders')} group by 1"


@both("articles_per_author", "articles", "authors")
def _(d):
    return f"select u.slug, count(*) as n from (select distinct id, author_id from {d.t('articles')}) a join {d.t('authors')} u on a.author_id = u.id group by u.slug"


@both("rows_per_entity_month", "orders", "customer")
def _(d):
    return f"select c.c_mktsegment as cohort, {d.month_key('o.o_orderdate')} as month, count(*) as n from {d.t('orders')} o join {d.t('customer')} c on o.o_custkey = c.c_custkey group by 1, 2"


@both("lookup_with_default", "customer", "nation", "region")
def _(d):
    """Left lookup joins with a default for misses."""
    return f"select c.c_custkey, coalesce(n.n_name, 'unknown') as nation, coalesce(r.r_name, 'unknown') as region from {d.t('customer')} c left join {d.t('nation')} n on c.c_nationkey = n.n_nationkey left join {d.t('region')} r on n.n_regionkey = r.r_regionkey"


@both("unmatched_rows", "customer", "orders")
def _(d):
    return f"select c_custkey from {d.t('customer')} c where not exists (select 1 from {d.t('orders')} o where o.o_custkey = c.c_custkey)"


@both("window_change_points", "events")
def _(d):
    """Events in closed windows of their entity: equality on the entity with a residual range."""
    e = d.t("events")
    return f"with w as (select user_id, event_id as wid, ts as lo, {d.plus('ts', 3)} as hi from {e} where event_type = 'error') select w.user_id, w.wid, count(*) as n, count(distinct e.event_type) as kinds from w join {e} e on e.user_id = w.user_id and e.ts between w.lo and w.hi group by 1, 2"


@both("month_window_overlap", "orders")
def _(d):
    """Months that touch a window of their entity, both ends inclusive."""
    o = d.t("orders")
    return f"with w as (select o_custkey as k, min(cast(o_orderdate as date)) as lo, {d.plus('min(cast(o_orderdate as date))', 90)} as hi from {o} group by 1), m as (select distinct o_custkey as k, cast({d.month('o_orderdate')} as date) as first_day from {o}) select w.k, count(*) as months from w join m on w.k = m.k and m.first_day <= w.hi and cast({d.plus('m.first_day', 27)} as date) >= w.lo group by 1"


ATTRIBUTION_SQL = """
with w as (select o.o_custkey as k, o.o_orderkey as wid, c.c_mktsegment as seg, o.o_orderdate as lo, o.o_orderdate + interval 5 day as hi from orders o join customer c on o.o_custkey = c.c_custkey where o.o_orderpriority = '1-URGENT'),
n as (select count(distinct k) as n from w where seg = 'BUILDING'),
t as (select t.k, t.wid, count(distinct b.k) as hits from w t left join w b on b.seg = 'BUILDING' and b.lo <= t.hi and t.lo <= b.hi where t.seg = 'MACHINERY' group by 1, 2)
select t.k, case when any_value(n.n) = 0 then 1.0 else avg(1 - t.hits / cast(n.n as double)) end as signal from t cross join n group by 1"""


@spelled("signal_attribution", ATTRIBUTION_SQL, "orders", "customer")
def _():
    """Share of control entities with an overlapping window, taken from 1, averaged over the target's windows.

    Windows meet in blocks of their own width of days: two that overlap have a block in common.
    """
    return """
with w as (select o.o_custkey as k, o.o_orderkey as wid, c.c_mktsegment as seg, o.o_orderdate as lo, o.o_orderdate + interval '5' day as hi from {orders} o join {customer} c on o.o_custkey = c.c_custkey where o.o_orderpriority = '1-URGENT'),
x as (select *, explode(sequence(floor(unix_date(cast(lo as date)) / 5), floor(unix_date(cast(hi as date)) / 5))) as block from w),
n as (select count(distinct k) as n from w where seg = 'BUILDING'),
h as (select t.k, t.wid, count(distinct b.k) as hits from x t join x b on t.block = b.block and t.seg = 'MACHINERY' and b.seg = 'BUILDING' and b.lo <= t.hi and t.lo <= b.hi group by 1, 2)
select w.k, case when any_value(n.n) = 0 then 1D else avg(1 - coalesce(h.hits, 0) / cast(n.n as double)) end as signal from w left join h on w.k = h.k and w.wid = h.wid cross join n where w.seg = 'MACHINERY' group by 1"""


@both("bisect_index", "events")
def _(d):
    """First index at or after an event's time in the entity's series, kept inside the series."""
    mid = "timestamp '2024-01-15 00:00:00'" if d.explode != "explode" else "timestamp_ntz'2024-01-15 00:00:00'"
    return f"select user_id, greatest(1, least(count(*) - 1, count(case when ts < {mid} then 1 end))) as idx from {d.t('events')} group by user_id"


@both("nearest_before_after", "events")
def _(d):
    mid = "timestamp '2024-01-15 00:00:00'" if d.explode != "explode" else "timestamp_ntz'2024-01-15 00:00:00'"
    before, after = d.argmax("event_id", "ts"), d.argmin("event_id", "ts")
    return f"select user_id, {before} filter (where ts <= {mid}) as before, {after} filter (where ts >= {mid}) as after from {d.t('events')} group by user_id"


@both("section_pairs", "orders")
def _(d):
    s = f"(select distinct o_orderpriority as s from {d.t('orders')})"
    return f"select a.s as a, b.s as b from {s} a join {s} b on a.s < b.s"


@both("plan_grid", "orders", "customer")
def _(d):
    """Every combination of two small dimensions."""
    return f"select a.s as segment, b.p as priority from (select distinct c_mktsegment as s from {d.t('customer')}) a cross join (select distinct o_orderpriority as p from {d.t('orders')}) b"


@both("scrape_audit", "articles")
def _(d):
    """Totals, missing times, flags and bounds in one pass."""
    return f"select count(*) as n, count(case when coalesce(scraped_at, '') = '' then 1 end) as missing, count(case when is_duplicate then 1 end) as flagged, min(word_count) as least, max(word_count) as most from (select distinct id, scraped_at, is_duplicate, word_count from {d.t('articles')}) x"


@both("entity_summary", "orders")
def _(d):
    """Count, span in days, mean of positive values, rows per year with a floor."""
    span = d.days("max(o_orderdate)", "min(o_orderdate)")
    mean, rate = "avg(case when o_totalprice > 0 then o_totalprice end)", f"count(*) / greatest({span} / 365.25e0, 0.01e0)"
    return f"select o_custkey, count(*) as n, {span} as days, {R(mean)} as mean, {R(rate)} as per_year from {d.t('orders')} group by o_custkey"


@both("monthly_metrics", "orders")
def _(d):
    return f"select o_custkey, {d.month_key('o_orderdate')} as month, {R('avg(o_totalprice)')} as mean, {R('median(o_totalprice)')} as mid, max(o_totalprice) as top from {d.t('orders')} group by 1, 2"


@both("section_mix", "orders")
def _(d):
    """Share of each section among an entity's rows of a month."""
    share = "count(*) / cast(sum(count(*)) over (partition by o_custkey, " + d.month_key("o_orderdate") + ") as double)"
    return f"select o_custkey, {d.month_key('o_orderdate')} as month, o_orderpriority as section, {R(share)} as share from {d.t('orders')} group by 1, 2, 3"


@both("section_mix_dense", "orders")
def _(d):
    """The same for all rows together, with zeros for sections without rows."""
    o = d.t("orders")
    return f"with m as (select distinct {d.month_key('o_orderdate')} as month from {o}), s as (select distinct o_orderpriority as section from {o}), c as (select {d.month_key('o_orderdate')} as month, o_orderpriority as section, count(*) as n from {o} group by 1, 2) select m.month, s.section, coalesce(c.n, 0) as n, {R('coalesce(c.n, 0) / cast(sum(coalesce(c.n, 0)) over (partition by m.month) as double)')} as share from m cross join s left join c on c.month = m.month and c.section = s.section"


@both("section_centroids", "events")
def _(d):
    return f"select event_type as section, 'value' as feature, {R('avg(value)')} as centroid from {d.t('events')} group by 1 union all select event_type, 'hour', {R('avg(cast(hour(ts) as double))')} from {d.t('events')} group by 1"


@both("best_per_family", "orders")
def _(d):
    """Row of the largest score per group, first key on ties."""
    return f"with x as (select o_custkey, o_orderpriority as family, o_orderkey, o_totalprice, row_number() over (partition by o_custkey, o_orderpriority order by o_totalprice desc, o_orderkey) as r from {d.t('orders')}) select o_custkey, family, o_orderkey, o_totalprice from x where r = 1"


@spelled("era_counts", "with b as (select o_custkey, o_orderdate < timestamp '1993-06-01' as a, o_orderdate >= timestamp '1993-06-01' and o_orderdate < timestamp '1995-01-01' as b, o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1997-03-01' as c, o_orderdate >= timestamp '1997-03-01' as d from orders), n as (select o_custkey, sum(a::int)::bigint as n1, sum(b::int)::bigint as n2, sum(c::int)::bigint as n3, sum(d::int)::bigint as n4 from b group by 1) select *, case greatest(n1, n2, n3, n4) when n1 then 'first' when n2 then 'second' when n3 then 'third' else 'fourth' end as dominant from n", "orders")
def _():
    """Each entity's dates counted in four eras, and the era that holds most of them, ties to the earliest."""
    return """
with e as (select o_custkey, case when o_orderdate < timestamp_ntz'1993-06-01 00:00:00' then 1 when o_orderdate < timestamp_ntz'1995-01-01 00:00:00' then 2 when o_orderdate < timestamp_ntz'1997-03-01 00:00:00' then 3 else 4 end as era from {orders}),
c as (select o_custkey, era, count(*) as n from e group by 1, 2)
select o_custkey, coalesce(sum(n) filter (where era = 1), 0) as n1, coalesce(sum(n) filter (where era = 2), 0) as n2, coalesce(sum(n) filter (where era = 3), 0) as n3, coalesce(sum(n) filter (where era = 4), 0) as n4, element_at(array('first', 'second', 'third', 'fourth'), max_by(era, struct(n, -era))) as dominant from c group by 1"""


@query("corpus_hash", "select substr(sha256(string_agg(content_hash, '|' order by content_hash)), 1, 12) as digest from (select distinct id, content_hash from articles where coalesce(content_hash, '') <> '' and not is_duplicate) x")
def corpus_hash(spark, sf_dir):
    """Digest of all content hashes in order; missing ones are left out. A digest has one order: the hashes are sorted by
    ranges in parallel and then read once as a stream, never gathered."""
    rows = table(spark, sf_dir, "articles", ["id", "content_hash", "is_duplicate"]).filter("coalesce(content_hash, '') <> '' and not is_duplicate")
    return ranks.ordered_digest(rows.select("id", "content_hash").distinct(), "content_hash")


@both("error_kinds_top50", "articles")
def _(d):
    key = d.sub("substr(coalesce(clean_text, ''), 1, 200)", "[0-9a-f]" * 6 + "+", "#")
    return f"select kind, count(*) as n from (select distinct id, {key} as kind from {d.t('articles')} where coalesce(word_count, 0) < 12) x group by kind order by n desc, kind limit 50"


@both("confusion_metrics", "articles")
def _(d):
    """Rates of a flag against a rule, 0 where a denominator is 0."""
    r = lambda a, b: R(f"coalesce({d.div(a, b)}, 0)")
    return f"with x as (select distinct id, is_duplicate as p, word_count < 250 as t from {d.t('articles')}), c as (select cast(count(case when p and t then 1 end) as double) as tp, cast(count(case when not p and t then 1 end) as double) as fn, cast(count(case when p and not t then 1 end) as double) as fp, cast(count(case when not p and not t then 1 end) as double) as tn from x) select {r('tp', 'tp + fn')} as sensitivity, {r('tn', 'tn + fp')} as specificity, {r('tp', 'tp + fp')} as precision_, {r('2 * tp', '2 * tp + fp + fn')} as f1 from c"


@both("class_separation", "events")
def _(d):
    return f"select {R('m1')} as human, {R('m2')} as machine, {R('m2 - m1')} as gap, m2 - m1 >= 0.05 as separated from (select avg(case when event_type = 'click' then value end) as m1, avg(case when event_type = 'error' then value end) as m2 from {d.t('events')}) x"


@both("cohort_summary", "customer")
def _(d):
    return f"select c_mktsegment, count(*) as n, cast(avg(c_acctbal) as double) as mean, max(c_acctbal) as top from {d.t('customer')} group by 1"


@both("changes_per_month", "orders")
def _(d):
    return f"select {d.month('o_orderdate')} as month, count(*) as n from {d.t('orders')} where o_totalprice > 200000 group by 1"


@both("zero_filled_categories", "orders")
def _(d):
    """Counts over a fixed list of categories."""
    cats = " union all ".join(f"select '{c}' as p" for c in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"))
    return f"select c.p as category, count(o.o_orderkey) as n from ({cats}) c left join {d.t('orders')} o on o.o_orderpriority = c.p group by 1"


@both("feature_correlation", "events")
def _(d):
    return f"select event_type, {R('corr(value, cast(hour(ts) as double))')} as r, {R('corr(value, cast(event_id as double))')} as trend from {d.t('events')} group by 1"


@query("survey_ranking", "select c_custkey, row_number() over (order by coalesce(c_acctbal, -1) desc, c_name) as rank_ from customer")
def survey_ranking(spark, sf_dir):
    """Rank by score, missing ones last, ties by name; places by ranges."""
    c = table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal", "c_name"]).withColumn("score", -F.coalesce("c_acctbal", F.lit(-1.0)))
    return ranks.ranked(c, ["score", "c_name"], rank="rank_", total="_n").select("c_custkey", "rank_")


@both("most_prolific", "articles")
def _(d):
    """Author of the most articles per outlet host."""
    host = d.group("coalesce(url, '')", r"^https?://([^/]+)/", 1)
    return f"with c as (select {host} as host, author_id, count(distinct id) as n from {d.t('articles')} group by 1, 2), r as (select host, author_id, n, row_number() over (partition by host order by n desc, author_id) as r from c) select host, author_id, n from r where r = 1"


@both("primary_vs_adjusted", "orders")
def _(d):
    """Two counts per entity and whether the second falls below half of the first."""
    return f"select o_custkey, count(*) as primary_, count(case when o_orderstatus = 'F' then 1 end) as adjusted, count(case when o_orderstatus = 'F' then 1 end) < count(*) / 2.0 as downgrade from {d.t('orders')} group by 1"


@both("adjusted_or_raw", "orders")
def _(d):
    """Adjusted rows of an entity, or its raw ones where it has no adjusted row."""
    return f"with x as (select o_custkey, o_orderkey, o_orderstatus = 'P' as adjusted, max(case when o_orderstatus = 'P' then 1 else 0 end) over (partition by o_custkey) as any_ from {d.t('orders')}) select o_custkey, o_orderkey from x where (any_ = 1 and adjusted) or (any_ = 0 and not adjusted)"


# ---- windows ----


@both("rolling_band", "events")
def _(d):
    """Rolling mean and deviation over rows, with the band of 1.96 deviations."""
    mean, std = f"avg(value) over ({EV} rows between 29 preceding and current row)", f"coalesce(stddev_samp(value) over ({EV} rows between 29 preceding and current row), 0)"
    return f"select event_id, {R(mean)} as mean, {R(std)} as std, {R(f'{mean} - 1.96 * {std}')} as lo, {R(f'{mean} + 1.96 * {std}')} as hi from {d.t('events')}"


RESIDUALIZED_SQL = """
with g as (select user_id, event_type, count(*) as n, avg(value) as m from events group by all),
e as (select user_id, count(*) as eligible from g where n >= 10 group by all),
a as (select user_id, avg(value) as m from events group by all)
select x.event_id, case when e.eligible >= 2 and g.n >= 10 then x.value - g.m + a.m else x.value end as adjusted
from events x join g on g.user_id = x.user_id and g.event_type = x.event_type join a on a.user_id = x.user_id left join e on e.user_id = x.user_id"""


@spelled("section_residualized", RESIDUALIZED_SQL, "events")
def _():
    """Values less their section's mean plus the entity's, in sections of ten rows, where at least two sections have them."""
    return """
with x as (select event_id, user_id, event_type, value, count(*) over (partition by user_id, event_type) as n, avg(value) over (partition by user_id, event_type) as s, avg(value) over (partition by user_id) as g from {events}),
y as (select *, size(collect_set(case when n >= 10 then event_type end) over (partition by user_id)) as eligible from x)
select event_id, case when eligible >= 2 and n >= 10 then value - s + g else value end as adjusted from y"""


TRAILING_SQL = """
with l as (select l_suppkey as k, l_orderkey as o, l_linenumber as i, l_partkey as p, l_extendedprice as x, cast(l_shipdate as date) as d from lineitem)
select a.o as l_orderkey, a.i as l_linenumber, a.p as l_partkey, a.x as l_extendedprice, count(*) filter (where a.d - b.d <= 7) as last_7, count(*) as last_30
from l a join l b on a.k = b.k and b.d <= a.d and a.d - b.d <= 30 and (b.d < a.d or (b.o, b.i, b.p, b.x) <= (a.o, a.i, a.p, a.x)) group by all"""


@spelled("trailing_counts", TRAILING_SQL, "lineitem")
def _():
    """Rows of the entity in the closed 7 and 30 days up to each row, itself included; of rows of the same day only those
    not behind it in sequence count, which a range frame alone would take in."""
    frame = lambda k: f"count(*) over (partition by l_suppkey order by d range between {k} preceding and current row)"
    later = "(count(*) over (partition by l_suppkey, d) - row_number() over (partition by l_suppkey, d order by l_orderkey, l_linenumber, l_partkey, l_extendedprice))"
    return f"select l_orderkey, l_linenumber, l_partkey, l_extendedprice, {frame(7)} - {later} as last_7, {frame(30)} - {later} as last_30 from (select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, unix_date(cast(l_shipdate as date)) as d from {{lineitem}}) x"


@both("inter_arrival_gap", "events")
def _(d):
    gap = f"coalesce(({d.micros('ts')} - lag({d.micros('ts')}) over ({EV})) / 8.64e10, 0)"
    return f"select event_id, {R(gap)} as days from {d.t('events')}"


@spelled("adaptive_window_days", "with g as (select user_id, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 8.64e10 as gap from events), m as (select user_id, list_sort(list(gap))[len(list(gap)) // 2 + 1] as mid from g where gap is not null group by 1) select user_id, cast(least(180, greatest(30, greatest(14, round_even(mid * 6, 0)))) as bigint) as days from m", "events")
def _():
    """Six times the upper median gap, rounded half to even, at least 14, between 30 and 180 days."""
    return """
with g as (select user_id, (timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) - lag(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)) over (partition by user_id order by ts, event_id)) / 8.64e10 as gap from {events}),
r as (select user_id, gap, row_number() over (partition by user_id order by gap) as i, count(*) over (partition by user_id) as n from g where gap is not null)
select user_id, cast(least(180, greatest(30, greatest(14, bround(gap * 6, 0)))) as bigint) as days from r where i = n div 2 + 1"""


@both("collapse_adjacent", "events")
def _(d):
    """Alarms within two places of the last one merged, the highest kept."""
    return f"with s as (select user_id, event_id, value, row_number() over ({EV}) as i from {d.t('events')}), a as (select * from s where value > 25), g as (select *, case when i - lag(i) over (partition by user_id order by i) <= 2 then 0 else 1 end as new_ from a), k as (select *, sum(new_) over (partition by user_id order by i rows between unbounded preceding and current row) as grp from g), r as (select *, row_number() over (partition by user_id, grp order by value desc, i) as r from k) select user_id, i, value from r where r = 1"


@both("burst_windows", "events")
def _(d):
    """Runs of gaps under half of the entity's median gap: start, end, level 2 where the mean gap is under a third."""
    gap = f"{d.micros('ts')} - lag({d.micros('ts')}) over ({EV})"
    return f"with g as (select user_id, event_id, ts, lag(ts) over ({EV}) as prev, {gap} as gap, row_number() over ({EV}) as i from {d.t('events')}), m as (select user_id, case when median(gap) <= 0 then 1000000.0 else median(gap) end as mid from g where gap is not null group by 1), f as (select g.*, m.mid, case when g.gap < m.mid / 2.0 then 1 else 0 end as fast from g join m on g.user_id = m.user_id where g.gap is not null), k as (select *, sum(1 - fast) over (partition by user_id order by i rows between unbounded preceding and current row) as run from f) select user_id, min(prev) as start_, max(ts) as end_, cast(case when avg(gap) < max(mid) / 3.0 then 2 else 1 end as bigint) as level from k where fast = 1 group by user_id, run"


@both("cusum_alarms", "events")
def _(d):
    """Two-sided cumulative sums against the mean and deviation of the series' head, in closed form."""
    return f"with s as (select user_id, event_id, value, row_number() over ({EV}) as i, count(*) over (partition by user_id) as n from {d.t('events')}), h as (select user_id, avg(value) as mu, coalesce(nullif(stddev_pop(value), 0), 1.0) as sd from s where i <= least(20, greatest(5, floor(n / 4))) group by 1), z as (select s.user_id, s.event_id, s.i, (s.value - h.mu) / h.sd as z from s join h on s.user_id = h.user_id), p as (select *, sum(z - 0.5) over (partition by user_id order by i rows between unbounded preceding and current row) as up, sum(-z - 0.5) over (partition by user_id order by i rows between unbounded preceding and current row) as dn from z), c as (select user_id, event_id, i, up - least(0, min(up) over (partition by user_id order by i rows between unbounded preceding and current row)) as hi, dn - least(0, min(dn) over (partition by user_id order by i rows between unbounded preceding and current row)) as lo from p) select user_id, i, {R('greatest(hi, lo)')} as score from c where greatest(hi, lo) > 4.0"


@both("cluster_density", "events")
def _(d):
    """Largest number of alarms in any window of ten places."""
    return f"with s as (select user_id, value, row_number() over ({EV}) as i from {d.t('events')}), a as (select user_id, i from s where value > 20), c as (select user_id, count(*) over (partition by user_id order by i range between current row and 9 following) as n from a) select user_id, max(n) as most from c group by 1"


@both("prefix_sums", "events")
def _(d):
    f = f"({EV} rows between unbounded preceding and current row)"
    return f"select event_id, {R(f'sum(value) over {f}')} as s1, {R(f'sum(value * value) over {f}')} as s2 from {d.t('events')}"


@both("changepoint_candidates", "events")
def _(d):
    """Of every split of a series of ten or more: means of both sides and the standardised difference."""
    f = f"({EV} rows between unbounded preceding and current row)"
    return f"with s as (select user_id, event_id, row_number() over ({EV}) as i, count(*) over (partition by user_id) as n, sum(value) over {f} as s1, sum(value * value) over {f} as s2, sum(value) over (partition by user_id) as t1, sum(value * value) over (partition by user_id) as t2 from {d.t('events')}), m as (select *, s1 / i as m1, (t1 - s1) / nullif(n - i, 0) as m2 from s where n >= 10 and i >= 5 and n - i >= 5), v as (select *, (s2 - i * m1 * m1) / (i - 1) as v1, ((t2 - s2) - (n - i) * m2 * m2) / (n - i - 1) as v2 from m) select user_id, i, {R('m1')} as before_mean, {R('m2')} as after_mean, {R('(m2 - m1) / nullif(sqrt(((i - 1) * v1 + (n - i - 1) * v2) / (n - 2)), 0)')} as d, case when m2 >= m1 then 'increase' else 'decrease' end as direction from v"


@both("peak_percentile", "orders")
def _(d):
    """Share of all an entity's months at or under the peak of its last six."""
    o = d.t("orders")
    return f"with m as (select o_custkey as k, {d.month_key('o_orderdate')} as month, avg(o_totalprice) as v from {o} group by 1, 2), r as (select *, row_number() over (partition by k order by month desc) as r from m), p as (select k, max(v) as peak from r where r <= 6 group by 1) select m.k, {R('avg(case when m.v <= p.peak then 1e0 else 0e0 end)')} as pct from m join p on m.k = p.k group by 1"


@both("thirds_drop", "events")
def _(d):
    """Fall from the first third of a series to its last, relative to the first, within 0 and 1."""
    drop = "(avg(case when i <= greatest(1, floor(n / 3)) then value end) - avg(case when i > n - greatest(1, floor(n / 3)) then value end)) / (abs(avg(case when i <= greatest(1, floor(n / 3)) then value end)) + 0.05)"
    return f"with s as (select user_id, value, row_number() over ({EV}) as i, count(*) over (partition by user_id) as n from {d.t('events')}) select user_id, {R(f'case when max(n) < 2 then 0 else least(1, greatest(0, {drop})) end')} as drop_ from s group by 1"


@both("sortedness", "events")
def _(d):
    return f"with x as (select user_id, ts, lag(ts) over ({EV}) as prev from {d.t('events')}) select user_id, count(case when prev > ts then 1 end) as inversions from x group by 1"


@both("velocity_acceleration", "orders")
def _(d):
    """Late against early mean of monthly changes, from six months on."""
    o = d.t("orders")
    return f"with m as (select o_custkey as k, {d.month_key('o_orderdate')} as month, avg(o_totalprice) as v from {o} group by 1, 2), l as (select k, month, abs(v - lag(v) over (partition by k order by month)) as d from m), r as (select k, d, row_number() over (partition by k order by month) as i, count(*) over (partition by k) as n from l where d is not null), a as (select k, max(n) as n, avg(case when i <= floor(n / 2) then d end) as early, avg(case when i > floor(n / 2) then d end) as late from r group by 1) select k, {R('least(1, greatest(0, (late - early) / early))')} as acceleration from a where n >= 6 and early > 0"


# ---- sets, limits ----


@query("artifact_sort_keys", "select c_custkey, row_number() over (order by cast(c_custkey as varchar)) as place from customer")
def artifact_sort_keys(spark, sf_dir):
    """Numbers ordered as text, as artifact keys are; places by ranges."""
    keys = table(spark, sf_dir, "customer", ["c_custkey"]).withColumn("key", F.col("c_custkey").cast("string"))
    return ranks.ranked(keys, ["key"], rank="place", total="_n").select("c_custkey", "place")


@both("top_orders", "orders")
def _(d):
    return f"select o_orderkey, o_totalprice from {d.t('orders')} order by o_totalprice desc, o_orderkey limit 10"


@both("union_by_name", "orders", "events")
def _(d):
    return f"select kind, count(*) as n, {R('avg(v)')} as mean from (select 'order' as kind, o_totalprice as v from {d.t('orders')} union all select 'event', value from {d.t('events')}) x group by kind"


@both("candidate_starts", "orders", "events")
def _(d):
    """Distinct union of the dates on which windows may start."""
    return f"select distinct cast(day as varchar(10)) as day from (select cast(o_orderdate as date) as day from {d.t('orders')} where o_totalprice > 250000 union select cast(ts as date) from {d.t('events')} where value > 45) x"


@both("entity_set_operations", "orders", "events")
def _(d):
    o, e = f"select distinct o_custkey as k from {d.t('orders')}", f"select distinct user_id as k from {d.t('events')}"
    return f"select 'both' as part, count(*) as n from ({o} intersect {e}) a union all select 'orders_only', count(*) from ({o} except {e}) b union all select 'events_only', count(*) from ({e} except {o}) c"


@spelled("exact_duplicates", "select doc_id, first_doc from (select doc_id, min(doc_id) over (partition by text) as first_doc from documents where text is not null and text <> '') x where doc_id > first_doc", "documents")
def _():
    """Documents whose text an earlier one has, with that one. Texts meet by their SHA-256: none is shuffled."""
    return "select doc_id, first_doc from (select doc_id, min(doc_id) over (partition by digest) as first_doc from (select doc_id, unhex(sha2(text, 256)) as digest from {documents} where text is not null and text <> '') d) x where doc_id > first_doc"


@both("spliced_corpus", "articles", "generated_articles", "authors")
def _(d):
    """The later articles of an author take generated texts in order; what has no partner stays."""
    a = f"select distinct id, author_id, {d.sha('clean_text')} as h from {d.t('articles')}"
    return f"with a as (select id, author_id, h, row_number() over (partition by author_id order by id) as i, count(*) over (partition by author_id) as n from ({a}) q), g as (select t.h, u.id as author_id, row_number() over (partition by u.id order by t.article_id) as i from (select distinct article_id, author_slug, {d.sha('text')} as h from {d.t('generated_articles')}) t join {d.t('authors')} u on u.slug = t.author_slug) select a.id, coalesce(g.h, a.h) as text_hash, g.h is not null as replaced from a left join g on g.author_id = a.author_id and g.i = a.i - floor(a.n / 2) and a.i > floor(a.n / 2)"


@both("direction_concordance", "orders")
def _(d):
    """Entities' directions of change against a table of expected directions."""
    return f"with x as (select o_custkey as k, o_orderpriority as f, avg(case when o_orderstatus = 'F' then o_totalprice end) - avg(case when o_orderstatus <> 'F' then o_totalprice end) as d from {d.t('orders')} group by 1, 2), p as (select '1-URGENT' as f, 'increase' as expected union all select '2-HIGH', 'decrease' union all select '5-LOW', 'increase') select x.k, count(case when p.expected is null then 1 end) as no_prior, count(case when p.expected = (case when x.d > 0 then 'increase' else 'decrease' end) then 1 end) as match_, count(case when p.expected <> (case when x.d > 0 then 'increase' else 'decrease' end) then 1 end) as oppose from x left join p on x.f = p.f where x.d is not null group by 1"

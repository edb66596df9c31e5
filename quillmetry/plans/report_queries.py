"""Rows of reports and of the corpus that need both engines' spelling: sentences, openers, model scores, windows of streams."""

from __future__ import annotations

import os
import sqlite3
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmetry.operators import analysis as an
from quillmetry.operators import documents as docs
from quillmetry.operators import ranks
from quillmetry.plans.analysis_queries import _long
from quillmetry.plans.catalog import query
from quillmetry.plans.dialect import spelled
from quillmetry.runtime import mounted, shared_folder
from quillmetry.sources import artifacts as art
from quillmetry.sources import files
from quillmetry.sources.tables import table
from quillmetry.streaming import streams

#: The direction in which a feature moves in generated prose; none where the evidence is mixed.
EXPECTED_DIRECTION = {
    "ai_marker_frequency": "increase", "formula_opening_score": "increase", "coleman_liau": "increase", "gunning_fog": "increase", "flesch_kincaid": "increase",
    "bigram_entropy": "decrease", "trigram_entropy": "decrease", "ttr": "decrease", "lexical_diversity": "decrease", "sent_length_std": "decrease", "sent_length_skewness": "decrease",
    "sent_length_mean": "increase", "self_similarity_30d": "increase", "self_similarity_90d": "increase", "conjunction_freq": "increase", "hedging_frequency": None,
}
#: Parts of a slug that mark a shared byline.
SHARED_TOKENS = ["staff", "newsroom", "desk", "editors", "team", "wire"]


def _sessions_sql() -> str:
    return "with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from e) select user_id, min(ts) as start_, max(ts) + interval 6 hour as end_, count(*) as n from s group by user_id, k"


def _plain_times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_", "end_") if c in df.columns})


@query("session_bursts", _sessions_sql())
def session_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user with gaps under six hours, as a stream counts them."""
    return _plain_times(streams.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours"))


@query("sliding_windows", "select user_id, w as start_, w + interval 7 day as end_, count(*) as n from (select user_id, unnest(generate_series(date_trunc('day', ts) - interval 6 day, date_trunc('day', ts), interval 1 day)) as w from events) x group by 1, 2")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user in windows of seven days that start every day."""
    return _plain_times(streams.sliding_counts(table(spark, sf_dir, "events"), "user_id", "ts"))


@query("first_seen_rows", "select distinct id, author_id from articles")
def first_seen_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article once, as an incremental insert keeps it."""
    return table(spark, sf_dir, "articles", ["id", "author_id"]).dropDuplicates(["id"])


STL_SQL = """
with k as (select user_id, count(*) as n from events group by 1 having count(*) >= 10 and stddev_pop(value) > 1e-9),
x as (select e.user_id as entity, row_number() over (partition by e.user_id order by e.ts, e.event_id) as i, e.value as v, k.n, greatest(3, least(30, greatest(3, k.n // 2))) as p from events e join k using (user_id)),
t as (select a.entity, a.i, any_value(a.v) as v, any_value(a.p) as p, avg(b.v) as trend from (select *, unnest(range(0, p)) as j from x) a join x b on b.entity = a.entity and b.i = least(a.n, greatest(1, a.i - a.p // 2 + a.j)) group by 1, 2),
s as (select entity, (i - 1) % p as place, avg(v - trend) as seasonal from t group by 1, 2)
select t.entity, t.i, t.trend, s.seasonal, t.v - t.trend - s.seasonal as rest from t join s on s.entity = t.entity and s.place = (t.i - 1) % t.p"""


@query("stl_components", STL_SQL)
def stl_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend, seasonal part and rest of each user's series."""
    from quillmetry.operators import changepoints as cp

    s = cp.series(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return cp.per_series(s, cp.decompose, "entity bigint, i bigint, trend double, seasonal double, rest double")


@query("sqlite_authors", "select id, slug, outlet from authors")
def sqlite_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of authors in a single file, made if it isn't there, read in ranges of its rows."""
    path = os.path.join(mounted(shared_folder(spark)), f"store-{os.getpid()}-{zlib.crc32(sf_dir.encode())}.sqlite")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    rows = [tuple(r) for r in table(spark, sf_dir, "authors", ["id", "slug", "outlet"]).toLocalIterator()]
    with sqlite3.connect(path, timeout=5) as con:
        con.execute("pragma journal_mode = wal")
        con.execute("create table if not exists authors (id text primary key, slug text, outlet text)")
        con.executemany("insert into authors values (?, ?, ?) on conflict (id) do update set slug = excluded.slug, outlet = excluded.outlet", rows)
    return docs.read_sqlite(spark, path, "authors", "id string, slug string, outlet string")


@query("export_bundle", "select 'articles' as name, count(*) as n from articles union all select 'authors', count(*) from authors union all select 'documents', count(*) from documents")
def export_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables exported into one folder, with the rows that are found there."""
    path = files._path(spark, "bundle")
    out = None
    for name in ("articles", "authors", "documents"):
        table(spark, sf_dir, name).write.parquet(f"{path}/{art.checked_name(name)}")
        n = spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("jsonl_manifest", "select count(*) as n, substr(sha256(string_agg(id, '|' order by id)), 1, 12) as digest from (select distinct id from articles) a")
def jsonl_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles written as JSON lines, and the manifest of what was read back: rows and a digest of their ids."""
    df = table(spark, sf_dir, "articles", ["id", "title"]).dropDuplicates(["id"])
    back = files.read_jsonl(spark, files.write_jsonl(df), df.schema)
    return back.agg(F.count("*").alias("n")).crossJoin(F.broadcast(ranks.ordered_digest(back, "id")))


@query("correlation_matrix", "select 'quantity' as a, 'price' as b, corr(l_quantity, l_extendedprice) as r from lineitem union all select 'quantity', 'discount', corr(l_quantity, l_discount) from lineitem union all select 'quantity', 'tax', corr(l_quantity, l_tax) from lineitem union all select 'price', 'discount', corr(l_extendedprice, l_discount) from lineitem union all select 'price', 'tax', corr(l_extendedprice, l_tax) from lineitem union all select 'discount', 'tax', corr(l_discount, l_tax) from lineitem")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of every pair of features in one pass, unpivoted."""
    columns = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    names = list(columns)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = table(spark, sf_dir, "lineitem", list(columns.values())).agg(*[F.corr(columns[a], columns[b]).alias(f"{a}|{b}") for a, b in pairs])
    wide = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs]))
    return one.select(wide.alias("x")).select("x.*")


@spelled("sentence_splits", r"with s as (select doc_id, unnest(regexp_split_to_array(regexp_replace(trim(text), '([.!?])\s+([A-Z0-9\"''])', '\1' || chr(30) || '\2', 'g'), chr(30))) as s from documents where trim(coalesce(text, '')) <> '') select doc_id, md5(s) as sentence, count(*) as n from s group by 1, 2", "documents")
def _():
    """The sentences of each document, by their hashes."""
    return r"""with s as (select doc_id, explode(split(regexp_replace(trim(text), r'([.!?])\s+([A-Z0-9"\x27])', concat('$1', char(30), '$2')), char(30))) as s from {documents} where trim(coalesce(text, '')) <> '') select doc_id, md5(s) as sentence, count(*) as n from s group by 1, 2"""


@spelled("sentence_openers", r"with s as (select lang, regexp_extract(lower(s), '[\pL]+') as w from (select lang, unnest(regexp_split_to_array(regexp_replace(trim(text), '([.!?])\s+([A-Z0-9\"''])', '\1' || chr(30) || '\2', 'g'), chr(30))) as s from documents where trim(coalesce(text, '')) <> '' and lang is not null) x), c as (select lang, w, count(*) as n from s where w <> '' group by 1, 2), r as (select *, row_number() over (partition by lang order by n desc, w) as place, sum(n) over (partition by lang) as total from c), e as (select lang, -sum(n / total * log2(n / total)) as bits from r group by 1) select r.lang, r.place, r.w as opener, r.n, e.bits from r join e using (lang) where place <= 10", "documents")
def _():
    """The ten most frequent first words of sentences of each language, and the entropy of all of them."""
    return r"""with s as (select lang, regexp_extract(lower(s), r'[\pL]+', 0) as w from (select lang, explode(split(regexp_replace(trim(text), r'([.!?])\s+([A-Z0-9"\x27])', concat('$1', char(30), '$2')), char(30))) as s from {documents} where trim(coalesce(text, '')) <> '' and lang is not null) x), c as (select lang, w, count(*) as n from s where w <> '' group by 1, 2), r as (select *, row_number() over (partition by lang order by n desc, w) as place, cast(sum(n) over (partition by lang) as double) as total from c), e as (select lang, -sum(n / total * log2(n / total)) as bits from r group by 1) select r.lang, r.place, r.w as opener, r.n, e.bits from r join e on r.lang = e.lang where place <= 10"""


def _perplexity(unnest: str) -> str:
    """Windows of fifty word pairs, each with its perplexity under add-one bigrams of the corpus, summed up by document."""
    return f"""with w as ({unnest}),
e as (select doc_id, i, w as a, lead(w) over (partition by doc_id order by i) as b from w),
g as (select * from e where b is not null),
c2 as (select a, b, cast(count(*) as double) as n from g group by 1, 2),
c1 as (select a, sum(n) as n from c2 group by 1),
v as (select cast(count(distinct b) as double) as v from c2),
l as (select g.doc_id, floor((g.i - 1) / 50) as win, -ln((c2.n + 1) / (c1.n + v.v)) as nll from g join c2 on c2.a = g.a and c2.b = g.b join c1 on c1.a = g.a cross join v),
p as (select doc_id, win, exp(avg(nll)) as ppl from l group by 1, 2)
select doc_id, count(*) as windows, avg(ppl) as mean, median(ppl) as mid, var_pop(ppl) as var, min(ppl) as low, max(ppl) as high, avg(case when ppl < 1000 then 1e0 else 0e0 end) as low_share from p group by 1"""


@spelled("perplexity_statistics", _perplexity(r"select doc_id, unnest(w) as w, generate_subscripts(w, 1) as i from (select doc_id, regexp_extract_all(lower(text), '[\pL]+') as w from documents where text is not null) x"), "documents")
def _():
    """Statistics of a document's perplexity over windows: mean, median, variance, ends and the share of low ones."""
    return _perplexity(r"select doc_id, w, i + 1 as i from (select doc_id, posexplode(regexp_extract_all(lower(text), r'[\pL]+', 0)) as (i, w) from {documents} where text is not null) x")


@spelled("repeated_sentence_gate", r"with s as (select article_id, lower(trim(s)) as s from (select article_id, unnest(regexp_split_to_array(text, '[.!?]+\s*')) as s from (select distinct article_id, text from generated_articles) d) x where trim(s) <> ''), n as (select article_id, count(*) as n, count(distinct s) as k from s group by 1) select article_id, 1 - k / cast(n as double) as repeated, 1 - k / cast(n as double) > 0.3 as rejected from n", "generated_articles")
def _():
    """The share of a generated text's sentences that stood before, and whether it is over the gate."""
    return r"""with s as (select article_id, lower(trim(s)) as s from (select article_id, explode(split(text, r'[.!?]+\s*')) as s from (select distinct article_id, text from {generated_articles}) d) x where trim(s) <> ''), n as (select article_id, count(*) as n, count(distinct s) as k from s group by 1) select article_id, 1 - k / cast(n as double) as repeated, 1 - k / cast(n as double) > 0.3 as rejected from n"""


_EXPECTED_SQL = ", ".join(f"('{k}', {'null' if v is None else chr(39) + v + chr(39)})" for k, v in EXPECTED_DIRECTION.items())


@query("direction_priors", f"with p as (select * from (values {_EXPECTED_SQL}) t(feature, expected)), n as (select list(feature order by feature) as names from p), x as (select event_id, names[1 + event_id % (len(names) + 1)] as feature, value - 50 as d from events cross join n), y as (select x.*, p.expected, case when d > 0 then 'increase' when d < 0 then 'decrease' end as direction from x left join p using (feature)) select direction, expected, case when expected is null or direction is null then 'no_prior' when direction = expected then 'match' else 'oppose' end as verdict, count(*) as n from y group by all")
def direction_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of effects against the table of expected ones, with features that aren't in it."""
    names = sorted(EXPECTED_DIRECTION)
    prior = spark.createDataFrame(sorted(EXPECTED_DIRECTION.items()), "feature string, expected string")
    feature = F.try_element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % (len(names) + 1) + 1).cast("int"))
    x = table(spark, sf_dir, "events", ["event_id", "value"]).select(feature.alias("feature"), (F.col("value") - 50).alias("d")).join(F.broadcast(prior), "feature", "left")
    direction = F.when(F.col("d") > 0, "increase").when(F.col("d") < 0, "decrease")
    verdict = F.when(F.col("expected").isNull() | direction.isNull(), "no_prior").when(direction == F.col("expected"), "match").otherwise("oppose")
    return x.groupBy(direction.alias("direction"), "expected", verdict.alias("verdict")).agg(F.count("*").alias("n"))


_TOKENS = ", ".join(f"'{t}'" for t in SHARED_TOKENS)


@query("shared_byline_rules", f"with a as (select id, lower(slug) as s, lower(name) as n, lower(split_part(outlet, '.', 1)) as o from authors) select id, case when s = o then 'outlet_slug' when starts_with(s, o || '-') then 'outlet_prefix' when len(list_intersect(string_split(s, '-'), [{_TOKENS}])) > 0 then 'token' when contains(n, ' and ') or contains(n, ' & ') then 'conjunction' when contains(n, ',') then 'comma' end as rule from a")
def shared_byline_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of five rules that marks a byline as shared; null for a person's."""
    s, n, o = F.lower("slug"), F.lower("name"), F.lower(F.element_at(F.split("outlet", r"\."), 1))
    token = F.arrays_overlap(F.split(s, "-"), F.array(*[F.lit(t) for t in SHARED_TOKENS]))
    rule = F.when(s == o, "outlet_slug").when(F.startswith(s, F.concat(o, F.lit("-"))), "outlet_prefix").when(token, "token").when(F.contains(n, F.lit(" and ")) | F.contains(n, F.lit(" & ")), "conjunction").when(F.contains(n, F.lit(",")), "comma")
    return table(spark, sf_dir, "authors", ["id", "slug", "name", "outlet"]).select("id", rule.alias("rule"))


@query("errors_by_source", r"with e as (select page_path, coalesce(nullif(regexp_extract(page_path, '^raw/([0-9]{4})/', 1), ''), nullif(regexp_extract(page_path, '^([^/]+)/', 1), ''), 'unknown') as source, http_status from raw_pages) select source, count(*) as n, count(*) filter (where http_status is null or http_status >= 400) as errors from e group by 1")
def errors_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and failed ones by where they come from, by the first pattern that fits."""
    first = lambda p: F.nullif(F.regexp_extract("page_path", p, 1), F.lit(""))
    source = F.coalesce(first(r"^raw/([0-9]{4})/"), first(r"^([^/]+)/"), F.lit("unknown"))
    bad = F.col("http_status").isNull() | (F.col("http_status") >= 400)
    return table(spark, sf_dir, "raw_pages", ["page_path", "http_status"]).groupBy(source.alias("source")).agg(F.count("*").alias("n"), F.count_if(bad).alias("errors"))


@query("preregistered_tests")
def preregistered_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch and rank tests of every feature of every supplier at a date set beforehand."""
    long = _long(spark, sf_dir)
    split = long.select("entity", "feature").distinct().select("entity", "feature", F.lit("preregistered").alias("method"), F.expr("timestamp'1996-01-01 00:00:00'").alias("ts"))
    return an.tests_at(long, split).filter("test in ('welch', 'mann_whitney', 'none')")


DRIFT_SQL = """
with e as (select vec_id, label, cast(floor(vec_id / 50) as int) as month, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
u as (select vec_id, label, month, unnest(v) as x, generate_subscripts(v, 1) as i from e),
m as (select label, month, list(x order by i) as v from (select label, month, i, avg(x) as x from u group by 1, 2, 3) z group by 1, 2),
o as (select vec_id, row_number() over (partition by label order by vec_id) as r from e),
b as (select label, list(x order by i) as v from (select u.label, u.i, avg(u.x) as x from u join o using (vec_id) where o.r <= 20 group by 1, 2) z group by 1),
a as (select list(x order by i) as v from (select i, avg(x) as x from u where label = 0 group by 1) z)
select m.label, m.month, 1 - list_cosine_similarity(m.v, lag(m.v) over (partition by m.label order by m.month)) as velocity, list_cosine_similarity(m.v, b.v) as baseline, list_cosine_similarity(m.v, a.v) as reference
from m join b using (label) cross join a"""


@query("drift_pipeline", DRIFT_SQL)
def drift_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each entity's months: how far the centroid moved, and its similarity to the baseline and to the reference entity."""
    from pyspark.sql import Window

    from quillmetry.operators.drift import cosine_distance

    e = table(spark, sf_dir, "embeddings").filter("embedding is not null").select("vec_id", "label", F.floor(F.col("vec_id") / 50).cast("int").alias("month"), F.col("embedding").cast("array<double>").alias("v"))
    placed = e.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")))
    spread = placed.select("label", "month", "r", F.posexplode("v").alias("i", "x"))

    def centre(rows: DataFrame, *keys: str) -> DataFrame:
        mean = rows.groupBy(*keys, "i").agg(F.avg("x").alias("x"))
        return mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("v"))

    months, base = centre(spread, "label", "month"), centre(spread.filter("r <= 20"), "label").withColumnRenamed("v", "b")
    reference = centre(spread.filter("label = 0").withColumn("one", F.lit(1)), "one").select(F.col("v").alias("a"))
    before = F.lag("v").over(Window.partitionBy("label").orderBy("month"))
    out = months.withColumn("p", before).join(base, "label").crossJoin(F.broadcast(reference))
    return out.select("label", "month", F.when(F.col("p").isNotNull(), cosine_distance(F.col("v"), F.col("p"))).alias("velocity"), (1 - cosine_distance(F.col("v"), F.col("b"))).alias("baseline"), (1 - cosine_distance(F.col("v"), F.col("a"))).alias("reference"))

"""Corpus operators on top of documents and vectors: peers, language-model scores, payloads, the drift pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmetry.operators import documents as docs
from quillmetry.operators import peers
from quillmetry.plans.catalog import query
from quillmetry.plans.dialect import both, spelled
from quillmetry.plans.dialect import rounded as R
from quillmetry.plans.text_queries import LETTERS, cosine, vec
from quillmetry.sources.tables import table


@spelled("trailing_peers", "select a.doc_id, count(*) as peers, min(b.doc_id) as first_peer from documents a join documents b on a.source = b.source and cast(b.published_at as date) < cast(a.published_at as date) and cast(a.published_at as date) - cast(b.published_at as date) <= 90 group by 1", "documents")
def _():
    """Earlier documents of the same source within 90 days, by a range frame: no pair of documents is formed."""
    frame = "over (partition by source order by day range between 90 preceding and 1 preceding)"
    return f"select * from (select doc_id, count(*) {frame} as peers, min(doc_id) {frame} as first_peer from (select doc_id, source, unix_date(cast(cast(published_at as timestamp_ntz) as date)) as day from {{documents}} where published_at is not null and source is not null) x) y where peers > 0"


SELF_SIMILARITY_SQL = r"""
with d as (select doc_id, source, cast(published_at as date) as day, regexp_extract_all(lower(text), '[\pL]+') as w from documents where published_at is not null and source is not null and text is not null),
f as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from d) group by all),
p as (select a.doc_id as a, b.doc_id as m from d a join d b on a.source = b.source and (a.doc_id = b.doc_id or (b.day < a.day and a.day - b.day <= 30))),
c as (select a, count(*) - 1 as peers from p group by all),
g as (select p.a, f.term, count(*) as df from p join f on p.m = f.doc_id group by all),
x as (select p.a, p.m, f.term, f.tf * (ln((1 + c.peers + 1) / (1.0 + g.df)) + 1) as x from p join c on p.a = c.a and c.peers >= 5 join f on p.m = f.doc_id join g on g.a = p.a and g.term = f.term),
l as (select a, m, sqrt(sum(x * x)) as len from x group by all),
s as (select u.a, v.m, sum(u.x * v.x) as dot from x u join x v on u.a = v.a and u.term = v.term and u.m = u.a and v.m <> v.a group by all),
r as (select p.a, avg(coalesce(s.dot / (lu.len * lv.len), 0)) as similarity from p join c on c.a = p.a and c.peers >= 5 left join s on s.a = p.a and s.m = p.m left join l lu on lu.a = p.a and lu.m = p.a left join l lv on lv.a = p.a and lv.m = p.m where p.m <> p.a group by all)
select c.a as doc_id, c.peers, r.similarity from c left join r on c.a = r.a where c.peers > 0"""


@query("self_similarity", SELF_SIMILARITY_SQL)
def self_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean TF-IDF cosine of a document to its peers of the last 30 days, from five peers on; every document has its own
    weights, fitted on itself and its peers."""
    d = table(spark, sf_dir, "documents", ["doc_id", "source", "published_at", "text"]).filter("published_at is not null and source is not null and text is not null")
    return peers.self_similarity(d.select("doc_id", "source", F.expr("unix_date(cast(cast(published_at as timestamp_ntz) as date))").cast("long").alias("day"), "text"))


@both("bigram_perplexity", "documents")
def _(d):
    """Perplexity of each document under add-one bigrams of the whole corpus, in place of a neural model."""
    pair = d.map(d.seq("1", f"{d.size}(w) - 1"), "i", d.struct(a=d.at("w", "i"), b=d.at("w", "i + 1")))
    return f"with w as (select doc_id, {d.all('lower(text)', LETTERS)} as w from {d.t('documents')} where text is not null), e as (select doc_id, {d.explode}({pair}) as p from w), b as (select doc_id, p.a as a, p.b as b, count(*) as c from e group by 1, 2, 3), c2 as (select a, b, cast(sum(c) as double) as n from b group by 1, 2), c1 as (select a, sum(n) as n from c2 group by 1), v as (select cast(count(distinct b) as double) as v from c2), s as (select b.doc_id, sum(b.c * ln((c2.n + 1) / (c1.n + v.v))) as ll, cast(sum(b.c) as double) as n from b join c2 on b.a = c2.a and b.b = c2.b join c1 on b.a = c1.a cross join v group by 1) select doc_id, exp(-ll / n) as perplexity from s"


@both("drift_summary", "embeddings")
def _(d):
    """Of each entity: months, mean and largest velocity, first and last similarity to the first month's centroid."""
    return f"with v as ({vec(d)}), c as (select label, month, pos, avg(v) as m from v group by 1, 2, 3), l as (select *, lag(m) over (partition by label, pos order by month) as p, first_value(m) over (partition by label, pos order by month) as f from c), s as (select label, month, case when count(p) = 0 then null else 1 - ({cosine('m', 'p')}) end as velocity, {cosine('m', 'f')} as sim from l group by 1, 2) select label, count(*) as months, {R('avg(velocity)')} as mean_velocity, {R('max(velocity)')} as top_velocity, {R(d.argmin('sim', 'month'))} as first_sim, {R(d.argmax('sim', 'month'))} as last_sim from s group by 1"


@both("split_means", "orders")
def _(d):
    """Fixed-date split of each entity's series: sizes, means and the share after it."""
    cut = d.ntz("'1998-01-01 00:00:00'")
    return f"select o_custkey, count(case when o_orderdate < {cut} then 1 end) as n_pre, count(case when o_orderdate >= {cut} then 1 end) as n_post, {R(f'avg(case when o_orderdate < {cut} then o_totalprice end)')} as before_mean, {R(f'avg(case when o_orderdate >= {cut} then o_totalprice end)')} as after_mean from {d.t('orders')} group by 1"


@both("volume_ratio", "orders")
def _(d):
    """Rows after a date to rows before it, where there are any before."""
    cut = d.ntz("'1998-01-01 00:00:00'")
    return f"with x as (select o_custkey, cast(count(case when o_orderdate < {cut} then 1 end) as double) as a, count(case when o_orderdate >= {cut} then 1 end) as b from {d.t('orders')} group by 1) select o_custkey, {R('b / a')} as ratio from x where a > 0"


@both("resume_filter", "customer", "orders")
def _(d):
    """Entities that a former run hasn't finished."""
    done = f"(select distinct o_custkey as k from {d.t('orders')} where o_orderstatus = 'F')"
    return f"select c.c_custkey from {d.t('customer')} c left join {done} x on c.c_custkey = x.k where x.k is null"


@both("hash_consistency", "generated_articles")
def _(d):
    """How many versions of each model stand behind the rows, and whether they are mixed."""
    return f"select model, count(distinct model_digest) as versions, count(distinct model_digest) > 1 as mixed from {d.t('generated_articles')} group by 1"


@query("clean_titles")
def clean_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", ["doc_id", "title"]).withColumn("clean", docs.clean_text("title"))


@query("stable_ids")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "authors", ["slug"]).withColumn("stable_id", docs.stable_id(uuid.NAMESPACE_URL, F.col("slug")))


@query("hashed_embeddings")
def hashed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the documents' texts by the hook for models, here with hashed words, and their lengths."""
    from quillmetry.operators import embeddings as em

    out = em.hashed(table(spark, sf_dir, "documents", ["doc_id", "text"]), "text")
    return out.select("doc_id", F.size("embedding").alias("dim"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x).alias("square"))


@query("page_bodies")
def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The story of each page by precedence of containers, by its lines, length and hash."""
    out = docs.article_bodies(table(spark, sf_dir, "raw_pages", ["page_path", "html"]), "page_path")
    return out.select("page_path", F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", "\n"))).alias("lines"), F.length("body").alias("chars"), F.md5("body").alias("body_hash"))


@query("page_metadata")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.page_metadata(table(spark, sf_dir, "raw_pages", ["page_path", "html"])).drop("html")


@query("generated_payloads")
def generated_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.generated_articles(table(spark, sf_dir, "generated_articles", ["article_id", "text"]).dropDuplicates(["article_id"]), "article_id", "text")

"""Queries of the operators for language-model training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmetry.llm import boilerplate, mixing, neardup, repetition, residue, sitelines, spans, tokenizer, truncation
from quillmetry.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles", ["id", "clean_text"]).withColumnRenamed("clean_text", "text")


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.found_repetition(repetition.corpus_records(table(spark, sf_dir, "articles"), table(spark, sf_dir, "generated_articles")))


@query("p2_shares")
def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's words, repeated words and share, and the share of words in lines labelled content."""
    records = repetition.corpus_records(table(spark, sf_dir, "articles"), table(spark, sf_dir, "generated_articles"))
    return repetition.repetition(records).dropDuplicates(["src", "id"])


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.found_near_duplicates(_texts(spark, sf_dir))


@query("p4_groups")
def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_texts(spark, sf_dir))


@query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.found_residue(table(spark, sf_dir, "articles"))


P6_SQL = r"""
with a as (select distinct id, author_id, clean_text from articles where author_id is not null and clean_text is not null),
long as (select *, string_split(clean_text, chr(10)) as lines from a where len(string_split(trim(regexp_replace(clean_text, '\s+', ' ', 'g')), ' ')) >= 50),
l as (select id, author_id, unnest(lines) as line, generate_subscripts(lines, 1) as line_no from long),
k as (select id, author_id, line_no, lower(trim(regexp_replace(regexp_replace(line, '\s+', ' ', 'g'), '\d+', '#', 'g'))) as k from l),
n as (select author_id, k from k where k <> '' group by 1, 2 having count(distinct id) >= 6)
select distinct k.id, k.line_no from k join n on k.author_id = n.author_id and k.k = n.k
"""


@query("p6_found", P6_SQL)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitelines.found_repeated_lines(table(spark, sf_dir, "articles"))


@query("p6_clean")
def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles without the repeated lines, by hash and length of the text that remains."""
    articles = table(spark, sf_dir, "articles")
    out = sitelines.without_lines(_texts(spark, sf_dir), sitelines.found_repeated_lines(articles))
    return out.select("id", "removed", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_hash"))


@query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.found_truncated(table(spark, sf_dir, "articles"))


@query("p7_rates")
def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(table(spark, sf_dir, "articles"), table(spark, sf_dir, "authors"))


@query("p7_outlet_rates")
def p7_outlet_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = truncation.truncation_rates(table(spark, sf_dir, "articles"), table(spark, sf_dir, "authors"))
    return rates.groupBy("outlet").agg(F.sum("articles").alias("articles"), F.sum("cut").alias("cut"), (F.sum("cut") / F.sum("articles")).alias("rate"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", ["doc_id", "text"])


@query("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(_documents(spark, sf_dir), "text").select("doc_id", "ids")


@query("p8_lengths")
def p8_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, characters and tokens by source, and documents whose decoded ids aren't the text again (none)."""
    docs = tokenizer.encode(table(spark, sf_dir, "documents", ["doc_id", "source", "text"]), "text")
    wrong = ~tokenizer.decode(F.col("ids")).eqNullSafe(F.coalesce("text", F.lit("")))
    return docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.sum(F.size("ids").cast("long")).alias("tokens"), F.count_if(wrong).alias("not_restored"))


@query("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents", ["doc_id", "source", "text"]), table(spark, sf_dir, "mix_targets"))


@query("p9_report")
def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.report(mixing.mixed(table(spark, sf_dir, "documents", ["doc_id", "source", "text"]), targets), targets)


@query("p9_budget_mix")
def p9_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of three quarters of the sources' tokens: the exponent is bisected to the repetition limits."""
    return mixing.mixed(table(spark, sf_dir, "documents", ["doc_id", "source", "text"]), table(spark, sf_dir, "mix_targets"), budget=0.75)


@query("p9_weights")
def p9_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights at the targets, at the budget of p9_budget_mix and at an entropy half-way, each with its exponent."""
    return mixing.weights_report(table(spark, sf_dir, "documents", ["doc_id", "source", "text"]), table(spark, sf_dir, "mix_targets"))


@query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.found_spans(_documents(spark, sf_dir))


@query("p10_shared")
def p10_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_length(_documents(spark, sf_dir))


@query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.boilerplate_lines(table(spark, sf_dir, "articles"), table(spark, sf_dir, "raw_pages"))


@query("p1_body")
def p1_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles' bodies, by lines removed, length and hash of what remains."""
    articles = table(spark, sf_dir, "articles")
    gone = boilerplate.boilerplate_lines(articles, table(spark, sf_dir, "raw_pages"))
    out = sitelines.without_lines(_texts(spark, sf_dir), gone)
    return out.select("id", "removed", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_hash"))

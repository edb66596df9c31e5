"""Queries of operators that SQL can't express: series, fingerprints, sources and sinks, topics, streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmetry.operators import changepoints as cp
from quillmetry.operators import fingerprints as fp
from quillmetry.plans.catalog import query
from quillmetry.runtime import written
from quillmetry.sources.tables import table


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.series(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


@query("pelt_breaks")
def pelt_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.pelt_breaks(_series(spark, sf_dir))


@query("pelt_breaks_l1")
def pelt_breaks_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.pelt_breaks(_series(spark, sf_dir), cost="l1")


@query("pelt_breaks_rbf")
def pelt_breaks_rbf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks by the kernel cost, whose penalty is a number of its own scale."""
    return cp.per_series(_series(spark, sf_dir), lambda x: cp.break_rows(x, [(b, None) for b in cp.pelt(x, 3.0, cost="rbf")]), cp.BREAKS)


@query("bocpd_breaks_normal")
def bocpd_breaks_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online detection with a known variance, and the older read-out of the probability of a new run (threshold 0.004)."""
    s = _series(spark, sf_dir)
    found = lambda **k: cp.per_series(s, lambda x: cp.break_rows(x, cp.bocpd(x, predictive="normal", **k)), cp.BREAKS)
    return found().withColumn("read_out", F.lit("reset")).unionByName(found(read_out="legacy", threshold=0.00401).withColumn("read_out", F.lit("legacy")))


@query("bocpd_breaks")
def bocpd_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.bocpd_breaks(_series(spark, sf_dir))


@query("evidence_gate")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _series(spark, sf_dir)
    return cp.evidence_gate(cp.pelt_breaks(s, 1.0), "pelt").withColumn("method", F.lit("pelt")).unionByName(cp.evidence_gate(cp.bocpd_breaks(s), "bocpd").withColumn("method", F.lit("bocpd")))


@query("two_sample_battery")
def two_sample_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.split_tests(_series(spark, sf_dir), lambda x: len(x) // 2)


@query("cluster_permutation")
def cluster_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.cluster_permutation(_series(spark, sf_dir), 20.0)


@query("null_calibration")
def null_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks that PELT finds in 200 series of 500 normal values, where there is none."""
    null = cp.null_breaks(spark.range(200).withColumnRenamed("id", "entity"))
    return null.groupBy("breaks").agg(F.count("*").alias("series"))


def _article_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(fp.fingerprints(table(spark, sf_dir, "articles", ["id", "clean_text"]).dropDuplicates(["id"]), "id", "clean_text"), "prints")


@query("simhash_pairs")
def simhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of articles whose prints differ in up to three bits."""
    return fp.near_pairs(_article_prints(spark, sf_dir), "id")


@query("simhash_pairs_wide")
def simhash_pairs_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same up to seven bits: more and shorter pieces, still no comparison of all pairs."""
    return fp.near_pairs(_article_prints(spark, sf_dir), "id", 7)


@query("simhash_classes")
def simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members of the classes of equal prints."""
    return fp.print_classes(_article_prints(spark, sf_dir), "id")


@query("earliest_of_duplicates")
def earliest_of_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document that was published first, ties to the smallest id; nulls come last."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "published_at"])
    groups = fp.duplicate_groups(docs, "doc_id", "text")
    return groups.join(docs.select("doc_id", "published_at"), "doc_id").groupBy("component").agg(F.min_by("doc_id", F.struct(F.col("published_at").isNull(), "published_at", "doc_id")).alias("kept"), F.count("*").alias("n"))


@query("duplicate_components")
def duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp.duplicate_groups(table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")


@query("feature_sink_round_trip", "select doc_id, lang, n_chars from documents")
def feature_sink_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written partitioned by a key, read back in one scan."""
    from quillmetry.sources import files

    return files.read_features(spark, files.write_features(table(spark, sf_dir, "documents", ["doc_id", "lang", "n_chars"]), "lang"))


@query("jsonl_round_trip", "select id, author_id, word_count from (select distinct id, author_id, word_count from articles) a")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmetry.sources import files

    df = table(spark, sf_dir, "articles", ["id", "author_id", "word_count"]).distinct()
    return files.read_jsonl(spark, files.write_jsonl(df), df.schema)


@query("drifting_shards", "select doc_id, lang, cast(null as varchar) as title from documents where doc_id % 2 = 0 union all select doc_id, lang, title from documents where doc_id % 2 = 1")
def drifting_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shards of different columns as one table: missing columns are null."""
    docs = table(spark, sf_dir, "documents")
    return written(docs.filter("doc_id % 2 = 0").select("doc_id", "lang"), "shard").unionByName(written(docs.filter("doc_id % 2 = 1").select("doc_id", "lang", "title"), "shard"), allowMissingColumns=True)


@query("topic_entropy")
def topic_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy in bits of each document's topic mixture under one model of the whole corpus."""
    from quillmetry.operators import topics

    return topics.topic_entropy(table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")


@query("topic_keywords")
def topic_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmetry.operators import topics

    return topics.topic_keywords(table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")


@query("centroid_projection")
def centroid_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities' centroids on their first two principal components."""
    from quillmetry.operators import topics

    return topics.projection(table(spark, sf_dir, "embeddings"), "label", "embedding")

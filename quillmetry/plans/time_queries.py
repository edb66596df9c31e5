"""Queries on mixed timestamps (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmetry.operators import timestamps as ts
from quillmetry.plans.catalog import query
from quillmetry.sources.tables import table


@query("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.found_timestamps(table(spark, sf_dir, "articles"), table(spark, sf_dir, "authors"), table(spark, sf_dir, "outlets"))


@query("p3_formats")
def p3_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each outlet writes its times: values by field and format, ambiguous ones, values that denote nothing."""
    long = ts.article_times(table(spark, sf_dir, "articles"), table(spark, sf_dir, "authors"), table(spark, sf_dir, "outlets")).dropDuplicates(["id", "field"])
    out = ts.normalise_timestamps(long, "value", "outlet", "tz_name", "date_order")
    return out.groupBy("outlet", "field", F.coalesce("format", F.lit("none")).alias("format")).agg(F.count("*").alias("n"), F.count_if("ambiguous").alias("ambiguous"))


@query("p3_mixture")
def p3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the interpretations of each outlet's times, fitted to the values alone, without the documented orders."""
    long = ts.article_times(table(spark, sf_dir, "articles"), table(spark, sf_dir, "authors"), table(spark, sf_dir, "outlets")).dropDuplicates(["id", "field"])
    read = ts.readings(long.withColumn("date_order", F.lit(None).cast("string")), "value", "tz_name", "date_order")
    return ts.format_mixture(read, "outlet").select(F.col("_source").alias("outlet"), F.explode("weights").alias("reading", "weight"))

"""Dispersion of vectors: by all pairs in small groups, by the centroid in large ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; a vector of length 0 is at distance 1 from all."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size < 1e-12, 1.0).otherwise(1.0 - dot(a, b) / size)


def dispersion(vectors: DataFrame, per_month: int = 50, most_pairs: int = 20) -> DataFrame:
    """vectors: vec_id, label, embedding. period (month, all), label, month, dispersion.

    Null embeddings are left out. A group of one vector has dispersion 0, one of up to `most_pairs` the mean distance of
    its pairs, a larger one the mean distance to its centroid, so pairs are bounded by the group's bound.
    """
    e = vectors.filter(F.col("embedding").isNotNull()).select("vec_id", "label", F.floor(F.col("vec_id") / per_month).cast("int").alias("month"), F.col("embedding").cast("array<double>").alias("v"))
    p = e.select(F.lit("month").alias("period"), "label", "month", "vec_id", "v").unionAll(e.select(F.lit("all"), "label", F.lit(None).cast("int"), "vec_id", "v"))
    p = p.withColumn("g", F.xxhash64("period", "label", "month"))
    n = p.groupBy("g", "period", "label", "month").agg(F.count("*").alias("n"))
    small, large = p.join(n.filter(F.col("n").between(2, most_pairs)).select("g"), "g"), p.join(n.filter(F.col("n") > most_pairs).select("g"), "g")
    pairs = small.select("g", F.col("vec_id").alias("a"), F.col("v").alias("va")).join(small.select("g", F.col("vec_id").alias("b"), F.col("v").alias("vb")), "g").filter("a < b")
    by_pairs = pairs.groupBy("g").agg(F.avg(cosine_distance(F.col("va"), F.col("vb"))).alias("d"))
    centre = large.select("g", F.posexplode("v").alias("i", "x")).groupBy("g", "i").agg(F.avg("x").alias("x")).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select("g", F.transform("c", lambda z: z["x"]).alias("c"))
    by_centre = large.join(centre, "g").groupBy("g").agg(F.avg(cosine_distance(F.col("v"), F.col("c"))).alias("d"))
    return n.join(by_pairs.unionAll(by_centre), "g", "left").select("period", "label", "month", F.coalesce("d", F.lit(0.0)).alias("dispersion"))

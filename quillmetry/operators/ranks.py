"""Ranks, prefix minima and corrections over a whole table, without one task that holds all of it.

Rows are range-partitioned by their order and written once; each range is ranked by itself, and a small table with a row
per range (and group) carries the counts and minima of the ranges around it. No window is ever over all rows.

Defined results: an empty table gives an empty one. Null p-values are no tests: they stay, with a null result, and count
for nothing. Equal p-values get equal results. Groups are compared null-safely as far as ranks go. Extra columns pass
through; the added names must be free.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmetry.runtime import written


def ranked(df: DataFrame, order: list, groups: list[str] | None = None, rank: str = "rk", total: str = "n") -> DataFrame:
    """Add the rank from 1 by `order` (columns that make it total) within the groups, their number of rows, and _range."""
    groups = groups or []
    spread = df.repartitionByRange(max(1, df.sparkSession.sparkContext.defaultParallelism), *groups, *order).withColumn("_range", F.spark_partition_id())
    spread = written(spread, "ranges")
    counts = spread.groupBy(*groups, "_range").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*groups, F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_range").alias("_r"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(*groups, F.lit(0))).alias(total))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    local = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*order))
    out = spread.withColumn("_local", local).join(offsets, same).withColumn(rank, F.col("_local") + F.col("_before"))
    return out.drop("_local", "_before", "_r", *[f"_g{i}" for i in range(len(groups))])


def benjamini_hochberg(df: DataFrame, p: str, key: str, groups: list[str] | None = None, q: str = "q") -> DataFrame:
    """Add q: the smallest p * n / rank from the row's rank on, 1 at most, within the groups."""
    groups = groups or []
    tested = ranked(df.filter(F.col(p).isNotNull()), [p, key], groups, "_rk", "_total").withColumn("_x", F.col(p) * F.col("_total") / F.col("_rk"))
    lows = tested.groupBy(*groups, "_range").agg(F.min("_x").alias("_low"))
    after = Window.partitionBy(*groups, F.lit(0)).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    lows = lows.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_range").alias("_r"), F.min("_low").over(after).alias("_later"))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    own = F.min("_x").over(Window.partitionBy(*groups, "_range").orderBy(F.desc("_rk")))
    out = tested.withColumn("_own", own).join(lows, same).withColumn(q, F.least(F.lit(1.0), F.col("_own"), F.col("_later")))
    out = out.select(*df.columns, q)
    return out.unionByName(df.filter(F.col(p).isNull()).withColumn(q, F.lit(None).cast("double")))


def bonferroni(df: DataFrame, p: str, q: str = "q") -> DataFrame:
    """Add q: p times the number of tests, 1 at most. The count is one row, joined to all."""
    n = df.agg(F.count(p).alias("_n"))
    return df.crossJoin(F.broadcast(n)).withColumn(q, F.least(F.lit(1.0), F.col(p) * F.col("_n"))).drop("_n")


def with_sum_before(df: DataFrame, value: str, weight: str, groups: list[str] | None = None, before: str = "before") -> DataFrame:
    """Add the sum of the weights of all smaller values of the group. One row per group and value."""
    groups = groups or []
    r = ranked(df, [value], groups, rank="_k", total="_m")
    sums = r.groupBy(*groups, "_range").agg(F.sum(weight).alias("_s"))
    earlier = Window.partitionBy(*groups, F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_range").alias("_r"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_earlier"))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    own = Window.partitionBy(*groups, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = r.withColumn("_own", F.coalesce(F.sum(weight).over(own), F.lit(0))).join(sums, same)
    return out.select(*df.columns, (F.col("_own") + F.col("_earlier")).alias(before))


def share_at_least(df: DataFrame, value: str, p: str = "p") -> DataFrame:
    """Add p: of all rows the share whose value is at least the row's (itself among them): an empirical tail probability.

    Values are counted first, so equal ones are one row, then ranked; no row meets another. Null values have no p.
    """
    counts = written(df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c")), "counts")
    total = counts.agg(F.sum("_c").alias("_all"))
    tail = with_sum_before(counts, "_v", "_c").crossJoin(F.broadcast(total)).select("_v", (1 - F.col("before") / F.col("_all")).alias(p))
    return df.join(tail, F.col(value) == F.col("_v"), "left").drop("_v")


def ordered_digest(df: DataFrame, value: str, separator: str = "|", length: int = 12) -> DataFrame:
    """One row, digest: the first characters of the SHA-256 of all values in their order, joined by the separator.

    The sort is parallel; one task then reads the sorted ranges one after another and keeps no more than a batch. Without
    rows there is no digest (null).
    """

    def run(batches):
        state, seen = hashlib.sha256(), False
        for b in batches:
            values = b.column(0).to_pylist()
            state.update(((separator if seen and values else "") + separator.join(values)).encode())
            seen = seen or bool(values)
        yield pa.RecordBatch.from_pydict({"digest": [state.hexdigest()[:length] if seen else None]}, pa.schema([("digest", pa.string())]))

    return df.filter(F.col(value).isNotNull()).select(value).sort(value).coalesce(1).mapInArrow(run, "digest string").agg(F.max("digest").alias("digest"))

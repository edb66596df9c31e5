"""Pairs of the values that share a key, with hot keys split into blocks.

The join key of a value is its key and one of ceil(n / BLOCK) parts, n being the rows of the key: one side holds each row
once, in the part of its hash, the other side once for every part. So no task meets more than BLOCK rows of one side at a
time with a key, however many rows the key has, and every pair is met exactly once. Keys of one row are left out first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmetry.runtime import broadcast_if_small, rows_of, written

BLOCK = 1000


def meet(rows: DataFrame, keys: list[str], value: str, block: int = BLOCK) -> DataFrame:
    """Distinct a < b of all values under an equal key. Null keys meet nothing."""
    plural = written(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1"), "plural")
    kept = rows.join(broadcast_if_small(plural, rows_of(plural)), keys)
    parts = F.ceil(F.col("_n") / block)
    a = kept.select(*keys, F.pmod(F.xxhash64(value), parts).alias("_part"), F.col(value).alias("a"))
    b = kept.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"), F.col(value).alias("b"))
    return a.join(b.hint("merge"), [*keys, "_part"]).filter("a < b").select("a", "b").distinct()

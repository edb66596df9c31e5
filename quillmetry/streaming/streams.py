"""Structured Streaming forms: the same functions take a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def sessions(events: DataFrame, entity: str, at: str, gap: str, late: str = "1 day") -> DataFrame:
    """entity, start, end, n of runs of events with gaps under `gap`; on a stream, rows later than `late` are dropped."""
    timed = events.withColumn("at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    out = timed.groupBy(entity, F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(entity, F.col("w.start").alias("start_"), F.col("w.end").alias("end_"), "n")


def first_seen(rows: DataFrame, key: str, at: str, late: str = "7 days") -> DataFrame:
    """Each key once, the incremental insert of unseen rows; a stream remembers keys for `late`."""
    timed = rows.withColumn(at, F.col(at).cast("timestamp"))
    return timed.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if rows.isStreaming else timed.dropDuplicates([key])


def sliding_counts(events: DataFrame, entity: str, at: str, width: str = "7 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """entity, window bounds and count of sliding windows."""
    timed = events.withColumn("at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    out = timed.groupBy(entity, F.window("at", width, step).alias("w")).agg(F.count("*").alias("n"))
    return out.select(entity, F.col("w.start").alias("start_"), F.col("w.end").alias("end_"), "n")


def limited_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 10) -> DataFrame:
    """A folder of Parquet files as a stream that takes at most so many files at a time: a rate limit for what follows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)

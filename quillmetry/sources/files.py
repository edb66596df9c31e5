"""Sinks and sources beside plain tables: partitioned features, JSON lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quillmetry.runtime import shared_folder

SCHEMA_VERSION = 2


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_features(df: DataFrame, partition: str, path: str | None = None) -> str:
    """Parquet partitioned by an entity key, so a reader of one entity opens only its folder."""
    path = path or _path(df.sparkSession, "features")
    df.write.partitionBy(partition).mode("overwrite").parquet(path)
    return path


def read_features(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All shards of a feature table, columns united by name."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    missing = [c for c in columns or [] if c not in df.columns]
    if missing:
        raise ValueError(f"feature table has no columns {missing}")
    return df.select(*columns) if columns else df


def write_jsonl(df: DataFrame, path: str | None = None) -> str:
    path = path or _path(df.sparkSession, "jsonl")
    df.write.mode("append").option("ignoreNullFields", False).json(path)
    return path


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines under an explicit schema; broken lines come out as nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)

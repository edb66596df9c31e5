"""Session helpers: lineage cuts in the shared folder, size checks, bounded broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a small side may be broadcast, by its rows and the width of its columns; beyond it the join is shuffled.
BROADCAST_BYTES = 16 << 20
_WIDTH = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.DateType: 4}
_tables: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, else one of our own, on a single machine only (as in tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="quillmetry-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def mounted(folder: str) -> str:
    """The path of a shared folder that is mounted as a file system; any other one is an error."""
    path = re.sub(r"^file:(?://)?", "", folder)
    if not path.startswith("/"):
        raise RuntimeError(f"single files need a mounted shared folder, not {folder}")
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete every table made by written(). Call it once the results that rest on them are stored."""
    while _tables:
        spark, path = _tables.pop()
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def rows_of(df: DataFrame) -> int:
    """Row count; on a table made by written() it comes from the Parquet footers alone."""
    return df.count()


def row_width(df: DataFrame) -> int:
    """Bytes of a row as a hash table holds it; strings and nested values count as 64."""
    return 32 + sum(_WIDTH.get(type(f.dataType), 64) for f in df.schema.fields)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint behind a check of its bytes; beyond it Spark plans a shuffled join."""
    return F.broadcast(df) if rows * row_width(df) <= limit else df

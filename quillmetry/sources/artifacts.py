"""Artifacts beside tables: gated feature files, migrations, manifests, vectors, JSON and CSV results, locks.

Big things are DataFrames written by executors; only small results (a configuration, a lock) are written by the driver,
to a temporary file that is renamed. All folders are those that executors share.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmetry.sources import files

NAME = re.compile(r"[A-Za-z_]\w*")
VERSION = "_schema_version"


def checked_name(name: str) -> str:
    """A plain word, fit for the name of a table or column; anything else is an error."""
    if not NAME.fullmatch(name):
        raise ValueError(f"not a plain name: {name!r}")
    return name


# ---- gated feature files and migrations ----


def write_versioned(df: DataFrame, path: str, version: int = files.SCHEMA_VERSION) -> str:
    """Feature rows with the version of their schema beside them, in a column that readers drop."""
    df.withColumn(VERSION, F.lit(version)).write.mode("overwrite").parquet(path)
    return path


def read_versioned(spark: SparkSession, path: str, order: list[str], least: int = files.SCHEMA_VERSION) -> DataFrame:
    """Rows in the order given. Older schemas, and tables without the order's columns, are an error when the rows are read."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    missing = [c for c in [*order, VERSION] if c not in df.columns]
    if missing:
        raise ValueError(f"feature table has no columns {missing}")
    gate = F.when(F.col(VERSION) < least, F.raise_error(F.concat(F.lit("schema of version "), F.col(VERSION).cast("string"), F.lit(f", {least} needed"))).cast("int")).otherwise(F.col(VERSION))
    return df.withColumn(VERSION, gate).filter(F.col(VERSION) > 0).drop(VERSION).orderBy(*order)


def read_entity(spark: SparkSession, path: str, key: str, value) -> DataFrame:
    """The rows of one entity, the filter pushed into the scan. An entity without rows has none: never the whole file."""
    return spark.read.option("mergeSchema", True).parquet(path).filter(F.col(key) == F.lit(value))


Migration = Callable[[DataFrame], DataFrame]


def migrate(df: DataFrame, version: int, steps: dict[int, Migration]) -> tuple[DataFrame, int]:
    """Apply the numbered steps above `version` in their order. A table of the newest version comes back as it is."""
    for number in sorted(n for n in steps if n > version):
        df, version = steps[number](df), number
    return df, version


def add_section(df: DataFrame, url: str = "url") -> DataFrame:
    """Version 1 to 2: the section, taken from the first part of the address's path, else 'unknown'. Kept where it is there."""
    if "section" in df.columns:
        return df
    return df.withColumn("section", F.coalesce(F.nullif(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-z]+://[^/]+/([^/?#]+)/", 1), F.lit("")), F.lit("unknown")))


# ---- manifests ----


def last_wins(shards: list[DataFrame], key: str) -> DataFrame:
    """Shards of a manifest in their order as one: columns by name, of each key the row that stands last."""
    numbered = [s.withColumn("_shard", F.lit(i)) for i, s in enumerate(shards)]
    out = numbered[0]
    for s in numbered[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_shard"), F.desc("_line")))
    return out.withColumn("_n", newest).filter("_n = 1").drop("_n", "_shard", "_line")


def rebuild_manifest(vectors: DataFrame, articles: DataFrame, key: str) -> DataFrame:
    """The manifest's rows from the vectors that are there and the articles' metadata; unmatched ids have matched = false."""
    known = articles.dropDuplicates([key]).withColumn("matched", F.lit(True))
    return vectors.select(key).distinct().join(known, key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


# ---- vectors ----


def pack(vectors: DataFrame, column: str, to: str = "packed") -> DataFrame:
    """A float array as little-endian 32-bit floats in one binary."""

    def run(batches):
        for b in batches:
            values = [None if v is None else np.asarray(v, "<f4").tobytes() for v in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.binary())], names=[*b.schema.names, to])

    return vectors.mapInArrow(run, vectors.withColumn(to, F.lit(None).cast("binary")).schema)


def unpack(packed: DataFrame, column: str, dim: int, to: str = "vector", strict: bool = False) -> DataFrame:
    """Binaries as arrays again. Those of another length than `dim` floats are left out, or an error if strict."""
    size = F.length(column)
    if strict:
        packed = packed.withColumn(column, F.when(size.isNull() | (size == 4 * dim), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("vector of bytes: "), size.cast("string"))).cast("binary")))
    packed = packed.filter(F.length(column) == 4 * dim)

    def run(batches):
        for b in batches:
            flat = np.frombuffer(b"".join(b.column(column).to_pylist()), "<f4")
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dim, pa.int32()), pa.array(flat, pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns, arrays], names=[*b.schema.names, to])

    return packed.mapInArrow(run, packed.withColumn(to, F.lit(None).cast("array<float>")).schema)


def load_vectors(sources: list[DataFrame], key: str, dim: int, revision: str | None = None, strict: bool = False) -> DataFrame:
    """Vectors of several sources (key, vector, revision) as one: of the dimension, and of the revision where one is given."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    ok = (F.size("vector") == dim) & (F.lit(True) if revision is None else F.col("revision").eqNullSafe(revision))
    if strict:  # no filter on ok: it would take the wrong rows away before they are noticed
        return out.withColumn(key, F.when(ok, F.col(key)).otherwise(F.raise_error(F.lit("vector of another dimension or revision")).cast(out.schema[key].dataType)))
    return out.filter(ok)


# ---- small results ----


def write_artifact(path: str | Path, payload) -> Path:
    """JSON with sorted keys, written to a temporary file of the same folder and renamed: readers see all of it or nothing."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=path.parent, prefix=".", suffix=".tmp")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(payload, f, indent=2, sort_keys=True, ensure_ascii=False)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
    except BaseException:
        Path(tmp).unlink(missing_ok=True)
        raise
    return path


def config_hash(config: dict, length: int = 16, exclude: frozenset[str] = frozenset()) -> str:
    """First characters of the SHA-256 of a configuration's sorted, compact JSON."""
    kept = {k: v for k, v in config.items() if k not in exclude}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:length]


def lock(path: str | Path, thresholds: dict) -> Path:
    """Snapshot of thresholds before an analysis, with their hash."""
    return write_artifact(path, {"thresholds": thresholds, "hash": config_hash(thresholds)})


def verify_lock(path: str | Path, thresholds: dict) -> list[str]:
    """What differs from the lock: changed, missing and added keys, or that the lock is missing or was edited."""
    if not Path(path).exists():
        return ["no lock"]
    held = json.loads(Path(path).read_text(encoding="utf-8"))
    then = held.get("thresholds", {})
    out = [] if held.get("hash") == config_hash(then) else ["lock was edited"]
    return out + sorted(k for k in {*then, *thresholds} if json.dumps(then.get(k), sort_keys=True) != json.dumps(thresholds.get(k), sort_keys=True))


def promote(spark: SparkSession, made: str, final: str) -> None:
    """Put a finished folder in place of the old one, whole or not at all: a folder without its success mark is an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    new, old = hadoop.Path(made), hadoop.Path(final)
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop.Path(f"{made}/_SUCCESS")):
        raise ValueError(f"not finished: {made}")
    aside = hadoop.Path(f"{final}.old")
    fs.delete(aside, True)
    if fs.exists(old) and not fs.rename(old, aside):
        raise OSError(f"in use: {final}")
    if not fs.rename(new, old):
        fs.rename(aside, old)
        raise OSError(f"not moved: {made}")
    fs.delete(aside, True)


def flatten_results(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """One row per JSON result: the file's name, its entity and each part as JSON text again. Broken files give no row."""
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value"))
    good = raw.filter(F.expr("try_parse_json(value)").isNotNull() & F.get_json_object("value", "$.entity").isNotNull())
    return good.select("file", F.get_json_object("value", "$.entity").alias("entity"), *[F.get_json_object("value", f"$.{checked_name(p)}").alias(p) for p in parts])


def decoded_numbers(column: Column, strict: bool = False) -> Column:
    """A JSON object of numbers as a map. What isn't one is null, or an error if strict; null stays null."""
    got = F.from_json(column, "map<string,double>")
    bad = column.isNotNull() & (got.isNull() | ~column.rlike(r"^\s*\{"))
    return F.when(bad, F.raise_error(F.lit("not a JSON object of numbers")).cast("map<string,double>") if strict else F.lit(None)).otherwise(got)

"""Lines repeated across one source's documents (problem 6), with compressed bitmaps of documents per line.

Each source's documents are numbered densely, in salted blocks so that no block holds a whole hot source. Every variant
of a line holds a bitmap of the documents it stands in, by source and block; the bitmaps of variants that agree after
normalisation are united, and the exact number of set bits decides. Bitmaps are Spark's 4 KB binaries, which shuffles
compress; lines that occur fewer than `least` times in all can't reach the threshold and never get one.

Defined results: null and empty texts have no lines; empty lines are no case; texts under `min_words` words are left
out; a null source or id is left out. A repeated row sets the same bits again and changes nothing. Extra columns are
never read. Hash keys have 64 bits and are always compared together with the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmetry.runtime import broadcast_if_small, rows_of, written

#: Rows of frequent lines by salted block of a source's documents, and the least number of blocks.
SALT_ROWS, SALTS = 500_000, 8
BLOCK = 32768


def normal_line(line: Column) -> Column:
    """Trimmed, white space joined, lower case, every run of digits one sign."""
    joined = F.trim(F.regexp_replace(F.regexp_replace(line, r"(?U)\s+", " "), r"(?U)\d+", "#"))
    return F.lower(joined)


def source_lines(records: DataFrame, source: str, min_words: int) -> DataFrame:
    """records: id, source, text. One row per non-empty line: source, id, line_no, key (normal form), variant."""
    text = F.coalesce(F.col("text"), F.lit(""))
    long_enough = F.size(F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " ")) >= min_words
    kept = records.filter(F.col(source).isNotNull() & F.col("id").isNotNull() & (F.length(text) >= 2 * min_words - 1)).filter(long_enough)
    lines = kept.select(F.col(source).alias("source"), "id", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    normal = lines.withColumn("normal", normal_line(F.col("line"))).filter("normal != ''")
    return normal.select("source", "id", (F.col("pos") + 1).cast("long").alias("line_no"), F.xxhash64("normal").alias("key"), F.xxhash64("line").alias("variant"))


def frequent_lines(lines: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The lines that stand in at least `least` documents of their source, as source, key, documents; and all their places."""
    often = written(lines.groupBy("source", "key").agg(F.count("*").alias("rows")).filter(F.col("rows") >= least).select("source", "key"), "often")
    held = written(lines.join(broadcast_if_small(often, rows_of(often)), ["source", "key"]), "held")
    salt = F.pmod(F.xxhash64("id"), F.lit(max(SALTS, rows_of(held) // SALT_ROWS))).cast("int")
    number = F.dense_rank().over(Window.partitionBy("source", "salt").orderBy("id")) - 1
    numbered = held.withColumn("salt", salt).withColumn("n", number)
    cells = numbered.select("source", "key", "variant", "salt", F.expr(f"n div {BLOCK}").alias("block"), (F.col("n") % BLOCK).cast("long").alias("bit"))
    bitmap = cells.groupBy("source", "key", "variant", "salt", "block").agg(F.bitmap_construct_agg("bit").alias("docs"))
    united = bitmap.groupBy("source", "key", "salt", "block").agg(F.bitmap_or_agg("docs").alias("docs"))
    counted = united.groupBy("source", "key").agg(F.sum(F.bitmap_count("docs")).alias("documents")).filter(F.col("documents") >= least)
    return counted, held


def repeated_lines(records: DataFrame, source: str, least: int = 6, min_words: int = 50) -> DataFrame:
    """source, id, line_no, documents: each place of a line that stands in `least` or more documents of one source."""
    lines = written(source_lines(records, source, min_words), "lines")
    counted, held = frequent_lines(lines, least)
    counted = written(counted, "counted")
    return held.join(broadcast_if_small(counted, rows_of(counted)), ["source", "key"]).select("source", "id", "line_no", "documents").distinct()


def found_repeated_lines(articles: DataFrame) -> DataFrame:
    records = articles.select("id", "author_id", F.col("clean_text").alias("text"))
    return repeated_lines(records, "author_id").select("id", "line_no").distinct()


def without_lines(records: DataFrame, places: DataFrame) -> DataFrame:
    """records: id, text. The texts with the lines at places (id, line_no) deleted: id, text, removed."""
    gone = places.groupBy("id").agg(F.collect_set("line_no").alias("gone"))
    joined = records.dropDuplicates(["id"]).join(gone, "id", "left")
    number = F.coalesce(F.col("gone"), F.array().cast("array<bigint>"))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(number, (i + 1).cast("long")))
    return joined.select("id", F.when(F.size(number) == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.size(number).alias("removed"))

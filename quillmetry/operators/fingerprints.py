"""Bit fingerprints of texts, banded near-duplicate candidates and connected groups.

A fingerprint has 128 bits in four bands of 32: per bit the sign of the votes of all character 3- and 4-grams, hashed
with xxh128. Texts within `most` differing bits agree wholly on one of most + 1 pieces of the 128 bits, so equality of a
piece finds all of them, whatever the distance asked for.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmetry.operators.pairs import meet
from quillmetry.runtime import written

#: Characters whose grams are in memory at a time.
CHUNK = 1_000_000


def _normal(text: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", text or "").split())


def _bits(grams: list[str]) -> np.ndarray:
    digests = b"".join(xxhash.xxh128_digest(g.encode("utf-8", "surrogatepass")) for g in grams)
    return np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 16), axis=1)


def simhash_bands_of(texts: list[str | None]) -> np.ndarray:
    """Four bands of each text, lowest first. A bit without a majority is 0.

    Each distinct gram of the texts is hashed once. A text without grams is one gram itself, an empty one a NUL. More
    than 65,535 different letters don't meet in a chunk.
    """
    values = [_normal(t) for t in texts]
    sizes = np.fromiter((len(v) for v in values), np.int64, len(values))
    at = np.r_[0, np.cumsum(sizes)]
    cp = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, code = np.unique(cp, return_inverse=True)
    votes, counts = np.zeros((len(values), 128), np.int64), np.zeros(len(values), np.int64)
    for n in (3, 4):
        last = len(cp) - n + 1
        if last <= 0:
            continue
        key = np.zeros(last, np.uint64)
        for k in range(n):
            key = key * np.uint64(len(letters) + 1) + code[k : k + last].astype(np.uint64)
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        bits = _bits([cp[i : i + n].tobytes().decode("utf-32-le", "surrogatepass") for i in first.tolist()])
        for i in np.flatnonzero(sizes >= n).tolist():
            mine = which[at[i] : at[i + 1] - n + 1]
            votes[i] += bits[mine].sum(0, dtype=np.int64)
            counts[i] += len(mine)
    for i in np.flatnonzero(sizes < 3).tolist():
        votes[i], counts[i] = _bits([values[i] or "\x00"])[0], 1
    weights = np.uint64(1) << np.arange(32, dtype=np.uint64)
    return ((2 * votes > counts[:, None]).reshape(-1, 4, 32) * weights).sum(2, dtype=np.uint64)


def simhash_bands(text: str) -> list[int]:
    return [int(x) for x in simhash_bands_of([text])[0]]


def fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, bands of texts that aren't null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lo, out = b.column(text).to_pylist(), 0, []
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= CHUNK):
                    chars += len(texts[hi])
                    hi += 1
                out.append(simhash_bands_of(texts[lo:hi]))
                lo = hi
            flat = np.concatenate(out).reshape(-1) if out else np.zeros(0, np.uint64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * 4, pa.int32()), pa.array(flat.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(key), bands], names=[key, "bands"])

    return docs.filter(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, bands array<bigint>")


def to_hex(bands: Column) -> Column:
    """A fingerprint as 32 hexadecimal digits, the highest band first."""
    return F.array_join(F.transform(F.reverse(bands), lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def from_hex(text: Column) -> Column:
    """The bands of 32 hexadecimal digits; null for anything else."""
    band = lambda k: F.conv(F.substring(text, 25 - 8 * k, 8), 16, 10).cast("long")
    return F.when(text.rlike("^[0-9a-fA-F]{32}$"), F.array(*[band(k) for k in range(4)]))


def distance(a: Column, b: Column) -> Column:
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(4)), F.lit(0))


def _pieces(bands: Column, n: int) -> Column:
    """The 128 bits in n pieces, each with its number: two prints that differ in under n bits have one in common."""
    word = lambda lo, hi: F.concat_ws("", *[F.substring(F.lpad(F.bin(bands[k]), 32, "0"), 33 - min(hi - 32 * k, 32), min(hi - 32 * k, 32) - max(lo - 32 * k, 0)) for k in range(4) if lo < 32 * k + 32 and hi > 32 * k])
    cuts = [round(i * 128 / n) for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("pos"), F.xxhash64(word(cuts[i], cuts[i + 1])).alias("cell")) for i in range(n)])


def near_pairs(prints: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Pairs a < b within `most` differing bits, with the distance; equal prints are one class, named by its smallest key.

    `print_classes` gives the members of the classes. Pieces that very many prints share are split into blocks.
    """
    if not 0 <= most <= 31:
        raise ValueError("distances of 0 to 31 bits")
    first = written(prints.groupBy("bands").agg(F.min(key).alias("id")), "prints")
    cells = first.select("id", F.explode(_pieces(F.col("bands"), most + 1)).alias("x")).select("x.pos", "x.cell", "id")
    pairs = meet(cells, ["pos", "cell"], "id")
    side = lambda name: first.select(F.col("id").alias(name), F.col("bands").alias(f"{name}_bands"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("distance", distance(F.col("a_bands"), F.col("b_bands")))
    return met.filter(F.col("distance") <= most).select("a", "b", "distance")


def print_classes(prints: DataFrame, key: str) -> DataFrame:
    """key, class (smallest key of equal prints) of every row."""
    return prints.join(prints.groupBy("bands").agg(F.min(key).alias("class")), "bands").select(key, "class")


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node) of an undirected graph, by alternating large and small stars.

    A large star hangs the larger neighbours of each node on the smallest one, a small star the smaller neighbours and
    the node itself. Both keep what is connected. It ends when every node hangs on a root, however many rounds that
    takes; the number of rounds grows with the logarithm of the nodes, for chains too. Each step is written.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    nodes = written(both.select(F.explode(F.array("x", "y")).alias("node")).distinct(), "nodes")
    edges = written(both.filter("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
    done = edges.isEmpty()
    while not done:
        ends = edges.select("x", "y").unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        low = ends.groupBy(F.col("x").alias("y")).agg(F.min(F.least("x", "y")).alias("low"))
        edges = written(edges.join(low, "y").select("x", F.col("low").alias("y")).distinct(), "large")
        low = edges.groupBy("x").agg(F.min("y").alias("low"))
        hung = edges.join(low, "x").filter("y != low").select(F.col("y").alias("x"), "low")
        edges = written(hung.unionAll(low).select("x", F.col("low").alias("y")).distinct(), "small")
        done = edges.groupBy("x").count().filter("count > 1").isEmpty() and edges.join(edges.select(F.col("x").alias("y")), "y", "left_semi").isEmpty()
    return nodes.join(edges.select(F.col("x").alias("node"), "y"), "node", "left").select("node", F.coalesce("y", "node").alias("component"))


def duplicate_groups(docs: DataFrame, key: str, text: str, most: int = 3) -> DataFrame:
    """key, component of every row with an equal or near fingerprint; the smallest key of a group stands for it."""
    prints = written(fingerprints(docs, key, text), "prints")
    part = connected(near_pairs(prints, key, most))
    classes = prints.groupBy("bands").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    rows = prints.join(classes, "bands").join(part.withColumnRenamed("node", "first"), "first", "left")
    return rows.filter("n > 1 or component is not null").select(key, F.coalesce("component", "first").alias("component"))

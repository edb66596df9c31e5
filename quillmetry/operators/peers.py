"""Documents against the earlier ones of their source, without a row for each pair.

A source is cut into blocks of days; a block holds its own documents and those of the days before it that their windows
reach. Only the documents are shuffled, so disk grows with them and not with their pairs; a task holds one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of a block, about. The blocks of sparse sources are longer, so that fewer documents stand in two.
BLOCK = 2000


def _similarities(day: np.ndarray, own: np.ndarray, words: list[np.ndarray], days: int, least: int) -> tuple[list[int], list[int], list[float | None]]:
    """day ascends. Place, number of peers and mean similarity of the own documents with peers.

    Documents of one day have the same peers, hence weights that differ in their own words alone: lengths under the
    peers' weights are made once a day and corrected for those words.
    """
    sizes = np.array([len(w) for w in words])
    _, term = np.unique(np.concatenate(words) if len(words) else np.zeros(0, np.int64), return_inverse=True)
    terms = int(term.max()) + 1 if len(term) else 0
    cells, tf = np.unique(np.repeat(np.arange(len(words)), sizes) * terms + term, return_counts=True)
    doc, term = np.divmod(cells, max(1, terms))
    ends = np.searchsorted(doc, np.arange(len(words) + 1))
    out: tuple[list, list, list] = ([], [], [])
    dots, gain = np.zeros(terms), np.zeros(terms)
    for d in np.unique(day[own]):
        lo, hi = np.searchsorted(day, [d - days, d])
        n = int(hi - lo)
        if not n:
            continue
        mine = hi + np.flatnonzero(own[hi : np.searchsorted(day, d, "right")])
        if n < least:
            for j in mine:
                out[0].append(int(j)), out[1].append(n), out[2].append(None)
            continue
        at = slice(ends[lo], ends[hi])
        t, f, m = term[at], tf[at].astype(float), doc[at] - lo
        df = np.bincount(t, minlength=terms)
        idf = np.log((2 + n) / (1.0 + df)) + 1
        squares = f * f
        base = np.bincount(m, squares * (idf * idf)[t], minlength=n)
        for j in mine:
            k, c = term[ends[j] : ends[j + 1]], tf[ends[j] : ends[j + 1]]
            weight = np.log((2 + n) / (2.0 + df[k])) + 1
            x = c * weight
            dots[k], gain[k] = x * weight, weight * weight - idf[k] * idf[k]
            dot, length = np.bincount(m, f * dots[t], minlength=n), np.sqrt(base + np.bincount(m, squares * gain[t], minlength=n))
            dots[k], gain[k] = 0, 0
            some = dot > 0
            out[0].append(int(j)), out[1].append(n), out[2].append(float((dot[some] / (length[some] * np.sqrt((x * x).sum()))).sum() / n))
    return out


def self_similarity(docs: DataFrame, days: int = 30, least: int = 5) -> DataFrame:
    """docs: doc_id, source, day (a number), text. doc_id, peers, similarity: the mean TF-IDF cosine to the documents of the
    source in the `days` before, null under `least` of them; every document has its own weights, fitted on itself and them.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("day").combine_chunks()
        column = lambda name: group.column(name).combine_chunks()
        lists = column("words")
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        at, peers, mean = _similarities(column("day").to_numpy(), column("own").to_numpy(zero_copy_only=False), [flat[a:b] for a, b in zip(ends[:-1], ends[1:])], days, least)
        return pa.table({"doc_id": column("doc_id").take(pa.array(at, "int64")), "peers": pa.array(peers, "int64"), "similarity": pa.array(mean, "float64")})

    densest = docs.groupBy("source", F.floor(F.col("day") / days).alias("b")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    span = days * max(1, min(12, BLOCK // max(1, densest)))
    spark = docs.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    block = F.floor(F.col("day") / span)
    placed = docs.withColumn("block", F.explode(F.array_distinct(F.array(block, F.floor((F.col("day") + days) / span))))).withColumn("own", F.col("block") == block)
    placed = placed.repartition(parts, "source", "block")  # texts are shuffled, as they pack better than hashes
    words = F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"[\pL]+"), F.lit(0)), lambda w: F.xxhash64(w))
    return placed.select("doc_id", "source", "block", "day", "own", words.alias("words")).groupBy("source", "block").applyInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, peers bigint, similarity double")

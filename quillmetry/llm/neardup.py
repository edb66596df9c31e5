"""Near-duplicate records with small edits (problem 4), by SuperMinHash, banding, verification and union-find.

SuperMinHash gives every element a random permutation of the m slots; at rank j the element offers rank j plus a random
fraction to its slot. An element stops as soon as j passes the largest rank still held in the document's slots, so a
signature costs a few ranks per element, not m. Bands of equal slots give candidates, exact set comparison verifies
them, large and small stars (a distributed union-find) name the groups.

Texts of equal words are one node first: a band bucket holds different texts only, so copies never meet pairwise,
and buckets of very many texts are split into blocks. They come back when `found_near_duplicates` writes the pairs that the problem defines.

Defined results: null and empty texts, and texts under `min_words` words, belong to no pair and no group. Repeated
rows of one id count once. Texts of any length are read whole. Ties don't arise: the threshold is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmetry.llm import textkit as tk
from quillmetry.operators.pairs import meet
from quillmetry.operators.fingerprints import connected
from quillmetry.runtime import broadcast_if_small, rows_of, written

#: Slots by band: 48 bands of 4 find a pair of similarity 0.6 with probability 0.9987, one of 0.8 in all but 1e-11.
BANDS, ROWS_PER_BAND = 48, 4
CHUNK = 1 << 16


def super_minhash(elements: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures, n_docs by m. elements: 64-bit hashes, grouped by ascending doc; repeats of an element do no harm.

    A slot holds rank * 2**32 + fraction of its smallest offer; a slot of a document without elements stays at the top.
    """
    top = np.iinfo(np.int64).max
    sig = np.full((n_docs, m), top, np.int64)
    lo = 0
    while lo < len(elements):
        hi = min(len(elements), lo + CHUNK)
        _offer(sig, elements[lo:hi], doc[lo:hi], m)
        lo = hi
    return sig


def _offer(sig: np.ndarray, elements: np.ndarray, doc: np.ndarray, m: int) -> None:
    slots = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), 1))
    alive, j = np.arange(len(elements)), 0
    flat = sig.reshape(-1)
    while len(alive) and j < m:
        r = tk.mix(elements[alive] + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        k = j + ((r >> np.uint64(32)) % np.uint64(m - j)).astype(np.int64)
        at = slots[alive, k].copy()
        slots[alive, k] = slots[alive, j]
        offer = (np.int64(j) << np.int64(32)) + (r & np.uint64(0xFFFFFFFF)).astype(np.int64)
        np.minimum.at(flat, doc[alive] * m + at, offer)
        j += 1
        held = sig[doc[0] : doc[-1] + 1].max(1) >> np.int64(32) >= j
        alive = alive[held[doc[alive] - doc[0]]]


def _shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all word runs in their order, the text of each, and the number of words of each text."""
    words = tk.words_of(texts)
    h, at = tk.run_hashes(words.hash, words.row, k)
    return h, words.row[at], np.bincount(words.row, minlength=len(texts))


def _distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
    return h[first], doc[first]


def signatures(records: DataFrame, k: int, min_words: int, bands: int = BANDS, rows: int = ROWS_PER_BAND) -> DataFrame:
    """records: id, text. One row per text long enough: id, set_hash (of its words in order) and an array of band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (c for whole in batches for c in tk.chunks(whole, "text")):
            h, doc, n_words = _shingles(b.column("text"), k)
            use = np.flatnonzero((n_words >= min_words) & (n_words >= k))
            to = np.full(b.num_rows, -1)
            to[use] = np.arange(len(use))
            mine = to[doc] >= 0
            h, doc = h[mine], to[doc[mine]]
            sig = super_minhash(h, doc, len(use), bands * rows).astype(np.uint64).reshape(len(use), bands, rows)
            band = np.zeros((len(use), bands), np.uint64)
            for r in range(rows):
                band = tk.mix(band + sig[:, :, r] + np.uint64(0x9E3779B97F4A7C15))
            band = tk.mix(band + np.arange(bands, dtype=np.uint64))
            place = (np.arange(len(doc)) - np.searchsorted(doc, doc)).astype(np.uint64)
            whole = np.zeros(len(use), np.uint64)
            np.add.at(whole, doc, tk.mix(h + place * np.uint64(0x9E3779B97F4A7C15)))
            offsets = pa.array(np.arange(len(use) + 1) * bands, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(use)), pa.array(whole.astype(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(band.reshape(-1).astype(np.int64)))], names=["id", "set_hash", "bands"])

    return records.select("id", "text").mapInArrow(run, f"id {records.schema['id'].dataType.simpleString()}, set_hash bigint, bands array<bigint>")


def shingle_sets(records: DataFrame, k: int) -> DataFrame:
    """id and the sorted distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (c for whole in batches for c in tk.chunks(whole, "text")):
            h, doc = _distinct(*_shingles(b.column("text"), k)[:2])
            offsets = np.r_[0, np.cumsum(np.bincount(doc, minlength=b.num_rows))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h.astype(np.int64)))], names=["id", "shingles"])

    return records.select("id", "text").mapInArrow(run, f"id {records.schema['id'].dataType.simpleString()}, shingles array<bigint>")


def classes(records: DataFrame, k: int, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Members id, node and bands node, bands: a node is a text, named by the hash of its words. One row per id, per node."""
    sig = written(signatures(records, k, min_words), "signatures").withColumnRenamed("set_hash", "node")
    return written(sig.select("id", "node").distinct(), "members"), sig.select("node", "bands").dropDuplicates(["node"])


def candidate_pairs(bands: DataFrame) -> DataFrame:
    """Distinct pairs a < b of nodes that share a band; a cell of many nodes is split into blocks."""
    return meet(bands.select("node", F.explode("bands").alias("cell")), ["cell"], "node")


def verified_pairs(records: DataFrame, members: DataFrame, pairs: DataFrame, k: int, threshold: float) -> DataFrame:
    """a, b, similarity of the candidate pairs whose exact Jaccard similarity is at least threshold."""
    pairs = written(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = written(members.join(wanted, "node").groupBy("node").agg(F.min("id").alias("id")), "wanted")
    texts = records.join(broadcast_if_small(wanted, rows_of(wanted)), "id")
    sets = written(shingle_sets(texts.select(F.col("node").alias("id"), "text"), k).dropDuplicates(["id"]), "shingles")
    sa, sb = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    counted = pairs.join(sa, "a").join(sb, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("total"))
    similarity = F.col("both") / (F.col("total") - F.col("both"))
    exact = F.col("both").cast("long") * 1_000_000 >= F.lit(round(threshold * 1_000_000)) * (F.col("total") - F.col("both"))
    return counted.filter(exact).select("a", "b", similarity.alias("similarity"))


def near_duplicates(records: DataFrame, k: int = 5, threshold: float = 0.8, min_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """Links a, b, similarity between nodes, and members id, node. Nothing is lost: copies share their node."""
    members, bands = classes(records, k, min_words)
    return written(verified_pairs(records, members, candidate_pairs(bands), k, threshold), "links"), members


def expand(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs id_a < id_b of the ids behind the links and within the classes of copies."""
    inside = meet(members.select("node", "id"), ["node"], "id").select(F.col("a").alias("x"), F.col("b").alias("y"))
    across = (
        links.select("a", "b")
        .join(members.select(F.col("node").alias("a"), F.col("id").alias("x")), "a")
        .join(members.select(F.col("node").alias("b"), F.col("id").alias("y")), "b")
        .select("x", "y")
    )
    return inside.unionAll(across).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def found_near_duplicates(records: DataFrame, k: int = 3, threshold: float = 0.6, min_words: int = 80) -> DataFrame:
    """id_a, id_b of all pairs of records whose sets of k-word runs are similar enough."""
    return expand(*near_duplicates(records, k, threshold, min_words))


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of an undirected graph a, b."""
    return connected(links)


def groups(records: DataFrame, k: int = 3, threshold: float = 0.6, min_words: int = 80) -> DataFrame:
    """One row per record with a near copy or an exact one: id, node (its text), group_id, links (of its node)."""
    links, members = near_duplicates(records, k, threshold, min_words)
    part = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    size = members.groupBy("node").agg(F.count("*").alias("copies"))
    out = members.join(size, "node").join(part, "node", "left").join(degree, "node", "left").filter("copies > 1 or component is not null")
    return out.select("id", "node", F.coalesce("component", "node").alias("group_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))

"""Long exact spans shared between records (problem 10), by FM-indexes over shards.

1. Winnowing picks an anchor, a K-gram, in every stretch of 200 characters of every text, so two texts with 200
   characters in common have a common anchor inside them, at the same place of both: of equal K-grams, as in loops, all
   are kept. Anchors of one text only are dropped. They only route: what is shared is found by the index.
2. Around each shared anchor the region that can hold such a span is cut, and goes to the shard of its anchor. The equal
   regions of a text, as inside a loop, are one with all their places.
3. A shard indexes its regions (suffix array, wavelet matrix of the Burrows-Wheeler transform). Every region is streamed
   backwards through the index: the interval of its last 200 characters is searched, then one character is put before
   and the interval widened to 200 characters again. These matching statistics, cut off at 200, give for each window of
   200 characters the interval of all its occurrences. An interval with occurrences of two texts is above the threshold:
   its windows are shared, and its members are linked. Only intervals that no common character extends to the left are
   reported, since the extended one holds the same members. No pair of regions is ever compared;
   only p10_found, whose result is pairs, pairs the members in the end.

Equal texts, and equal regions, are one until the end: copies never meet pairwise. An anchor with more than `crowd`
different regions would be too much for one index: its windows of 200 characters meet under 128 bits of hashes in place
of intervals, with the same result. All other spans are compared exactly.

Defined results: null texts and texts under 200 characters share nothing. Texts are read whole, as written, by Unicode
code point. A doc_id that occurs in several rows is one record per text. Texts and regions are named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmetry.llm import textkit as tk
from quillmetry.llm.fmindex import FmIndex
from quillmetry.operators.pairs import meet
from quillmetry.runtime import broadcast_if_small, rows_of, written

LEAST = 200
K = 48
SHARD_REGIONS = 3000
#: Different regions of one anchor that an index may hold.
CROWD = 2000


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over x[i : i + w], for every i with a whole window, by doubling."""
    done, cur = 1, x
    while done * 2 <= w:
        cur = op(cur[:-done], cur[done:])
        done *= 2
    rest = w - done
    return op(cur[: len(cur) - rest], cur[rest:]) if rest else cur


def winnow(cp: np.ndarray, at: np.ndarray, k: int = K, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts one after another: hash, text, place. Every stretch of `least` characters of a text has one."""
    w = least - k + 1
    n = len(cp) - k + 1
    none = np.zeros(0, np.int64)
    if n < w:
        return none.astype(np.uint64), none, none
    s = tk.prefix_hashes(cp)
    start = np.arange(n)
    h = tk.span_hashes(s, start, start + k)
    low = _sliding(h, w, np.minimum)
    text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = text_of[: len(low)] == text_of[least - 1 : least - 1 + len(low)]
    low[~inside] = 0  # a window over two texts picks nothing
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    high = _sliding(padded, w, np.maximum)
    place = np.flatnonzero((high == h) & (h != 0))
    doc = text_of[place]
    return h[place], doc, place - at[doc]


def anchors(documents: DataFrame, k: int = K, least: int = LEAST) -> DataFrame:
    """documents: t, text. Rows h, t, pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (c for whole in batches for c in tk.chunks(whole, "text")):
            cp, at = tk.code_points(b.column("text"))
            h, doc, pos = winnow(cp, at, k, least)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), b.column("t").take(pa.array(doc)), pa.array(pos.astype(np.int32))], names=["h", "t", "pos"])

    return documents.select("t", "text").mapInArrow(run, "h bigint, t bigint, pos int")


def regions(texts: DataFrame, hits: DataFrame, k: int = K, least: int = LEAST) -> DataFrame:
    """rid, t, starts, left, region: the characters around the shared anchors that can belong to a span with them.

    One row for all places of a text with equal surroundings.
    """
    side = least - k
    by_text = hits.groupBy("t").agg(F.collect_set("pos").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (c for whole in batches for c in tk.chunks(whole, "text")):
            found: dict[tuple[int, int, str], list[int]] = {}
            for t, text, places in zip(*(b.column(c).to_pylist() for c in ("t", "text", "places"))):
                for pos in places:
                    start = max(pos - side, 0)
                    found.setdefault((t, pos - start, text[start : pos + k + side]), []).append(start)
            t, left, region = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(found.values(), pa.list_(pa.int32())), pa.array(left, pa.int32()), pa.array(region, pa.string())], names=["t", "starts", "left", "region"])

    cut = texts.join(by_text, "t").select("t", "text", "places").mapInArrow(run, "t bigint, starts array<int>, left int, region string")
    return cut.withColumn("rid", F.xxhash64("left", "region"))


def _spans_in_shard(frame: pd.DataFrame, least: int) -> pd.DataFrame:
    """The shard's regions with windows of `least` characters that two texts have: rid, first and last of them, intervals.

    frame: rid, region, lo_t and hi_t (the smallest and largest text of the region), shard. One row per region.
    """
    values = frame["region"].tolist()
    sizes = np.fromiter((len(v) for v in values), np.int64, len(values))
    cp = np.frombuffer("\0".join(values).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32).astype(np.int64) + 1
    begin = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    cp[begin + sizes] = 0
    index = FmIndex(cp, least)
    begins, ends = index.intervals()
    owner = np.repeat(np.arange(len(values)), sizes + 1)[index.sa]
    heads = np.flatnonzero(np.r_[True, begins[1:] != begins[:-1]])
    least_t, most_t = np.minimum.reduceat(frame["lo_t"].to_numpy()[owner], heads), np.maximum.reduceat(frame["hi_t"].to_numpy()[owner], heads)
    plural = np.repeat(least_t < most_t, np.diff(np.r_[heads, len(begins)]))
    live = np.flatnonzero(sizes >= least)
    at = begin + sizes - least
    lo, hi = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    lo[live], hi[live] = index.search(at[live], at[live] + least)
    first, last = np.full(len(values), -1, np.int64), np.full(len(values), -1, np.int64)
    regions_of, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(live):
        shared = plural[lo[live]]
        place = at[live] - begin[live]
        first[live[shared]] = place[shared]
        last[live[shared]] = np.maximum(last[live[shared]], place[shared])
        more = place > 0
        left, right = index.extend(index.text[at[live] - 1], lo[live], hi[live])
        ended = shared & ~(more & (right - left == hi[live] - lo[live]))
        regions_of.append(live[ended])
        cells.append(lo[live[ended]])
        lo[live], hi[live] = begins[np.minimum(left, len(begins) - 1)], ends[np.minimum(left, len(ends) - 1)]
        at[live] -= 1
        live = live[more]
    region, cell = np.concatenate(regions_of), np.concatenate(cells)
    order = np.argsort(region, kind="stable")
    split = np.split(cell[order], np.searchsorted(region[order], np.arange(1, len(values))))
    keep = np.flatnonzero(first >= 0)
    return pd.DataFrame({"rid": frame["rid"].to_numpy()[keep], "first": first[keep].astype(np.int32), "last": last[keep].astype(np.int32), "cells": pd.Series([split[i] for i in keep], dtype=object), "shard": frame["shard"].to_numpy()[keep]})


SHARD_SCHEMA = "rid bigint, first int, last int, cells array<bigint>, shard bigint"


def shared_spans(documents: DataFrame, k: int = K, least: int = LEAST, crowd: int = CROWD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents: doc_id, text. Three tables: members (t, doc_id), cells (c1, c2, t: texts that share a window) and spans (t, lo, hi)."""
    long = documents.filter(F.length("text") >= least).withColumn("t", F.xxhash64("text"))
    members = written(long.select("t", "doc_id").distinct(), "members")
    first = members.groupBy("t").agg(F.min("doc_id").alias("doc_id"))
    found = written(anchors(long, k, least), "anchors")
    shared = written(found.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo < hi").select("h"), "shared")
    hits = written(found.join(broadcast_if_small(shared, rows_of(shared)), "h", "left_semi").select("t", "pos").distinct(), "hits")
    wanted = written(hits.select("t").distinct().join(first, "t"), "wanted")
    texts = long.select("t", "doc_id", "text").join(broadcast_if_small(wanted, rows_of(wanted)), ["t", "doc_id"], "left_semi").dropDuplicates(["t"])
    cut = written(regions(texts, hits, k, least), "regions")
    uses = cut.select("rid", "t", F.explode("starts").alias("start"))
    one = cut.filter(F.length("region") >= least).groupBy("rid").agg(F.first("left").alias("left"), F.first("region").alias("region"), F.min("t").alias("lo_t"), F.max("t").alias("hi_t"))
    one = written(one.withColumn("anchor", F.xxhash64(F.substring("region", F.col("left") + 1, F.lit(k)))), "one")
    sizes = written(one.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    met = one.join(broadcast_if_small(sizes, rows_of(sizes)), "anchor", "left")
    # a region without others under its anchor is shared whole, if at all
    alone = met.filter("n is null and lo_t < hi_t").select("rid", F.lit(0).alias("first"), (F.length("region") - least).alias("last"), F.array(F.struct(F.lit(-1).cast("long").alias("c1"), F.col("rid").alias("c2"))).alias("cells"))
    total = sizes.filter(F.col("n") <= crowd).agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // SHARD_REGIONS))
    indexed = met.filter(F.col("n") <= crowd).select("rid", "region", "lo_t", "hi_t", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    streamed = indexed.groupBy("shard").applyInPandas(lambda f: _spans_in_shard(f, least), SHARD_SCHEMA)
    streamed = streamed.select("rid", "first", "last", F.transform("cells", lambda c: F.struct(F.col("shard").alias("c1"), c.alias("c2"))).alias("cells"))
    met_windows = written(alone.unionAll(streamed).unionAll(_crowded(met.filter(F.col("n") > crowd), least)), "windows")
    cells = met_windows.select("rid", F.explode("cells").alias("c")).join(cut.select("rid", "t"), "rid").select("c.c1", "c.c2", "t").distinct()
    spans = met_windows.join(uses, "rid").select("t", (F.col("start") + F.col("first")).alias("lo"), (F.col("start") + F.col("last") + least).alias("hi")).distinct()
    return members, cells, spans


def _crowded(met: DataFrame, least: int) -> DataFrame:
    """The regions under crowded anchors, like those of a shard: their shared windows, with two hashes of each as its cell."""
    starts = F.sequence(F.lit(0), F.length("region") - least)
    text = lambda i: F.col("region").substr(i + 1, F.lit(least))
    each = met.select("rid", "lo_t", "hi_t", F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(text(i)).alias("c1"), F.xxhash64(F.lit(1), text(i)).alias("c2")))).alias("x")).select("rid", "lo_t", "hi_t", "x.*")
    plural = each.groupBy("c1", "c2").agg(F.min("lo_t").alias("x"), F.max("hi_t").alias("y")).filter("x < y").select("c1", "c2")
    return each.join(plural, ["c1", "c2"]).groupBy("rid").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.collect_list(F.struct("c1", "c2")).alias("cells"))


def found_spans(documents: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_a < doc_b of all pairs of documents with at least 200 characters in common."""
    members, cells, _ = shared_spans(documents, crowd=crowd)
    pairs = meet(written(cells, "cells"), ["c1", "c2"], "t").select(F.col("a").alias("ta"), F.col("b").alias("tb"))
    inside = meet(members, ["t"], "doc_id").select(F.col("a").alias("x"), F.col("b").alias("y"))
    across = pairs.join(members.select(F.col("t").alias("ta"), F.col("doc_id").alias("x")), "ta").join(members.select(F.col("t").alias("tb"), F.col("doc_id").alias("y")), "tb").filter("x != y").select("x", "y")
    return inside.unionAll(across).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def shared_length(documents: DataFrame) -> DataFrame:
    """Each document's number of characters, how many of them lie in spans shared with another one, and the share."""
    members, _, spans = shared_spans(documents)
    copied = members.groupBy("t").agg(F.count("*").alias("copies"))
    merged = spans.groupBy("t").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("s"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
    add = lambda acc, x: F.struct(F.greatest(acc["end"], x["hi"]).alias("end"), (acc["sum"] + F.greatest(x["hi"] - F.greatest(x["lo"], acc["end"]), F.lit(0))).alias("sum"))
    covered = merged.select("t", F.aggregate("s", start, add, lambda acc: acc["sum"]).alias("covered"))
    of = members.join(copied, "t").join(covered, "t", "left").select("doc_id", "copies", F.coalesce("covered", F.lit(0)).alias("covered"))
    docs = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    out = docs.join(of, "doc_id", "left").withColumn("shared", F.when(F.col("copies") > 1, F.col("chars")).otherwise(F.coalesce("covered", F.lit(0))))
    return out.select("doc_id", "chars", "shared", F.when(F.col("chars") > 0, F.col("shared") / F.col("chars")).otherwise(0.0).alias("share"))

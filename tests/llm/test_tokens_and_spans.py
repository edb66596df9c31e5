from __future__ import annotations

import collections
import itertools
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmetry.llm import mixing, spans, tokenizer

TEXTS = [None, "", " ", "Hello world", "It's 1,234 o'clock — naïve café 😀😀\n\n\tend  ", "日本語のテキストです。", "a" * 300, "<|endoftext|> x", "\u0000\u0007 odd �", "def f(x):\n    return x ** 2\n", "don't WE'LL they've   ", "x  y 　"]


@pytest.mark.skipif(not Path(tokenizer.RANKS).exists(), reason="no vocabulary files")
def test_ids_equal_the_library_and_decode_restores(spark):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN.replace("(?U)", ""), mergeable_ranks=tokenizer.read_ranks(), special_tokens={})
    df = spark.createDataFrame(list(enumerate(TEXTS)), "ids_of bigint, text string")
    for hot in (5, 65536):
        out = tokenizer.encode(df, "text", hot=hot).withColumn("back", tokenizer.decode(F.col("ids"))).collect()
        for r in out:
            assert r.ids == (enc.encode_ordinary(r.text) if r.text else []), r.text
            assert r.back == (r.text or "")
    assert tokenizer.encode(df.limit(0), "text").count() == 0


def pairs_of(docs):
    at = collections.defaultdict(set)
    for i, t in docs:
        for p in range(len(t or "") - 199):
            at[t[p : p + 200]].add(i)
    return {p for v in at.values() for p in itertools.combinations(sorted(v), 2)}


def documents():
    rng = np.random.default_rng(9)
    letters = list("abcdefghij éß日")
    text = lambda n: "".join(rng.choice(letters, n))
    shared = [text(n) for n in (199, 200, 201, 260, 500)]
    docs = [(i, text(int(rng.integers(150, 700)))) for i in range(40)]
    for k in range(25):
        docs.append((100 + k, text(int(rng.integers(0, 200))) + shared[k % 5] + text(int(rng.integers(0, 200)))))
    loop = "tick tock " * 60
    docs += [(200, None), (201, ""), (202, docs[0][1]), (203, docs[0][1]), (204, loop), (205, "say " + loop[:300]), (206, text(100) + loop[7:320] + text(90)), (207, "z" * 450), (208, "y" + "z" * 230 + "y")]
    return docs


@pytest.mark.parametrize("crowd", [2000, 3])
def test_spans_equal_brute_force(spark, crowd):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_a, r.doc_b) for r in spans.found_spans(df, crowd=crowd).collect()}
    assert got == pairs_of(docs)


def test_the_index_decides(spark, monkeypatch):
    """Without the intervals of the index only regions that are equal as a whole would be left."""
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert pairs_of(docs) == {(r.doc_a, r.doc_b) for r in spans.found_spans(df).collect()}
    index = spans.FmIndex
    alone = type("Alone", (index,), {"intervals": lambda self: (np.arange(len(self.sa)), np.arange(len(self.sa)) + 1)})
    frame = pd.DataFrame({"rid": [1, 2], "region": ["x" * 9 + "ab" * 60 + "cd" * 60, "y" * 9 + "ab" * 60 + "cd" * 60], "lo_t": [1, 2], "hi_t": [1, 2], "shard": [0, 0]})
    assert spans._spans_in_shard(frame, 200)["rid"].tolist() == [1, 2]
    monkeypatch.setattr(spans, "FmIndex", alone)
    assert spans._spans_in_shard(frame, 200).empty


@pytest.mark.parametrize("period", range(2, 200, 7))
def test_periods_within_one_shard(period):
    rng = np.random.default_rng(period)
    loop = "".join(rng.choice(list("abcdefgh"), period)) * (800 // period + 1)
    regions = [loop[:352], loop[period // 2 : period // 2 + 352], "#" * 100 + loop[3:203] + "#" * 52, "+" * 100 + loop[5:204] + "+" * 52]
    frame = pd.DataFrame({"rid": range(4), "region": regions, "lo_t": range(4), "hi_t": range(4), "shard": 0})
    at = collections.defaultdict(set)
    for i, t in enumerate(regions):
        for p in range(len(t) - 199):
            at[t[p : p + 200]].add(i)
    want = {i: {p for p in range(len(t) - 199) if len(at[t[p : p + 200]]) > 1} for i, t in enumerate(regions)}
    got = spans._spans_in_shard(frame, 200).set_index("rid")
    assert {i: (min(w), max(w)) for i, w in want.items() if w} == {i: (r["first"], r["last"]) for i, r in got.iterrows()}
    by_cell = collections.defaultdict(set)
    for i, r in got.iterrows():
        for c in r["cells"]:
            by_cell[c].add(i)
    assert {p for v in by_cell.values() for p in itertools.combinations(sorted(v), 2)} == {p for v in at.values() for p in itertools.combinations(sorted(v), 2)}


def loops():
    rng = np.random.default_rng(11)
    letters = list("abcdefghijklmnop")
    text = lambda n: "".join(rng.choice(letters, n))
    docs = [(0, text(90) * 40), (1, "")]
    docs[1] = (1, "in front " + docs[0][1] + " behind")
    for k, period in enumerate((1, 7, 47, 90, 152, 153)):
        loop = text(period) * (2000 // period)
        docs += [(10 * (k + 1), text(60) + loop + text(60))]
        docs += [(10 * (k + 1) + j, text(150) + loop[at : at + n] + text(150)) for j, (at, n) in enumerate([(313, 210), (701, 222), (499, 199), (560, 216)], 1)]
    return docs


@pytest.mark.parametrize("crowd", [2000, 3])
def test_spans_of_loops_equal_brute_force(spark, crowd):
    docs = loops()
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert pairs_of(docs) == {(r.doc_a, r.doc_b) for r in spans.found_spans(df).collect()}
    at = collections.defaultdict(set)
    for i, t in docs:
        for p in range(len(t) - 199):
            at[t[p : p + 200]].add(i)
    want = {i: len({q for p in range(len(t) - 199) if len(at[t[p : p + 200]]) > 1 for q in range(p, p + 200)}) for i, t in docs}
    members, _, found = spans.shared_spans(df, crowd=crowd)
    doc, got = {r.t: r.doc_id for r in members.collect()}, collections.defaultdict(set)
    for r in found.collect():
        got[doc[r.t]] |= set(range(r.lo, r.hi))
    assert {i: len(got[i]) for i in want} == want


def test_shared_length(spark):
    docs = documents()
    got = {r.doc_id: r for r in spans.shared_length(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert len(got) == len(docs) and got[0].share == 1.0 and got[200].shared == 0
    assert {i for i, r in got.items() if r.shared} == {i for p in pairs_of(docs) for i in p}
    assert all(200 <= r.shared <= r.chars for r in got.values() if r.shared)


def test_every_stretch_has_an_anchor():
    rng = np.random.default_rng(1)
    cp = rng.integers(97, 123, 5000).astype(np.uint32)
    _, _, pos = spans.winnow(cp, np.array([0, 5000]))
    assert all(((pos >= i) & (pos <= i + 200 - spans.K)).any() for i in range(0, 4800))


def test_weights():
    tokens, goal = {"a": 1000, "b": 100, "c": 5}, {"a": (0.5, 1), "b": (0.4, 4), "d": (0.1, 2)}
    w, budget, a = mixing.plan_weights(tokens, goal)
    assert a == 1.0 and budget == 900 and w == pytest.approx({"a": 5 / 9, "b": 4 / 9})
    w, budget, a = mixing.plan_weights(tokens, goal, budget=1200)
    assert 0 < a < 1 and 1200 * w["b"] <= 400 * (1 + 1e-6) and 1200 * w["a"] <= 1000 * (1 + 1e-6)
    w, _, _ = mixing.plan_weights(tokens, goal, target_entropy=0.5)
    assert mixing.entropy(w) == pytest.approx(0.5, abs=1e-6)
    assert mixing.plan_weights({}, goal) == ({}, 0, 1.0)
    # the exponent decides: a budget that the targets can't fill moves every weight towards the token shares
    full, large, half = mixing.plan_weights(tokens, goal)[0], mixing.plan_weights(tokens, goal, budget=1090), mixing.plan_weights(tokens, goal, budget=1000)
    assert 0 < large[2] < half[2] < 1 and large[0]["a"] > half[0]["a"] > full["a"]
    assert 1000 * half[0]["b"] == pytest.approx(400) and 1090 * large[0]["b"] == pytest.approx(400)


def test_mix_reaches_its_shares(spark):
    rng = np.random.default_rng(0)
    rows = [(i, str(rng.choice(["a", "a", "a", "b"])), int(rng.integers(1, 40))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    tokens = {s: sum(n for _, x, n in rows if x == s) for s in "ab"}
    w, budget, _ = mixing.plan_weights(tokens, {"a": (0.4, 1), "b": (0.6, 3)})
    used = mixing.mix(docs, w, budget, tokens, {"a": 1, "b": 3}).collect()
    size = {s: sum(r.n_tokens * r.copies for r in used if r.source == s) for s in "ab"}
    assert abs(size["a"] / sum(size.values()) - 0.4) < 0.001
    assert max(r.copies for r in used if r.source == "a") == 1 and max(r.copies for r in used if r.source == "b") <= 3
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 3), ("none", None, None)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.report(spark.createDataFrame(used), targets).collect()}
    assert got["none"].tokens == 0 and got["a"].actual_share + got["b"].actual_share == pytest.approx(1)

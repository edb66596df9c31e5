from __future__ import annotations

import itertools
import re

import numpy as np
import pytest

from quillmetry.llm import neardup as nd
from quillmetry.operators import pairs
from quillmetry.operators import fingerprints as fp


def shingles(t: str, k: int = 3) -> set:
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def texts() -> list[tuple[str, str | None]]:
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    out: list[tuple[str, str | None]] = [("null", None), ("empty", ""), ("short", "a b c")]
    for g in range(12):
        base = list(rng.choice(words, 140))
        for k in range(4):
            edited = list(base)
            for _ in range(k * 4):
                edited[int(rng.integers(len(edited)))] = str(rng.choice(words))
            out.append((f"d{g}-{k}", " ".join(edited)))
        out.append((f"d{g}-copy", " ".join(base)))
    return out


def test_pairs_equal_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([*rows, rows[5]], "id string, text string")
    got = sorted((r.id_a, r.id_b) for r in nd.found_near_duplicates(df).collect())
    long = [(i, shingles(t)) for i, t in rows if t and len(t.split()) >= 80]
    want = sorted(tuple(sorted((a, b))) for (a, x), (b, y) in itertools.combinations(long, 2) if len(x & y) >= 0.6 * len(x | y))
    assert got == want and len(want) > 12


def test_groups_are_components(spark):
    df = spark.createDataFrame(texts(), "id string, text string")
    groups = {r.id: r.group_id for r in nd.groups(df).collect()}
    for r in nd.found_near_duplicates(df).collect():
        assert groups[r.id_a] == groups[r.id_b]
    assert nd.found_near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [nd.components, fp.connected])
def test_long_chains_are_one_component(spark, parts):
    ids = np.random.default_rng(7).permutation(500).tolist()
    links = [(min(p), max(p)) for p in itertools.pairwise(ids)] + [(1000, 1001), (1002, 1002)]
    got = {r.node: r.component for r in parts(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == dict.fromkeys(range(500), 0) | {1000: 1000, 1001: 1000, 1002: 1002}
    assert parts(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        seen = []
        for _ in range(30):
            el = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
            both, k = int(300 * share), (300 - int(300 * share)) // 2
            a, b = np.r_[el[:both], el[both : both + k]], np.r_[el[:both], el[both + k :]]
            s = nd.super_minhash(np.r_[a, b], np.r_[np.zeros(len(a), int), np.ones(len(b), int)], 2, 192)
            seen.append((s[0] == s[1]).mean())
        assert abs(np.mean(seen) - share) < 0.02


def test_signature_ignores_order_and_repeats():
    el = np.arange(1, 90, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a = nd.super_minhash(el, np.zeros(len(el), int), 1, 192)
    twice = np.concatenate([el[::-1], el])
    assert (a == nd.super_minhash(twice, np.zeros(len(twice), int), 1, 192)).all()


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_hot_keys_are_split_without_loss(spark, block):
    rows = [(k, v) for k, n in (("hot", 40), ("b", 5), ("c", 1)) for v in range(n)] + [(None, 1), (None, 2), ("b", 3), ("d", 2)]
    got = sorted((r.a, r.b) for r in pairs.meet(spark.createDataFrame(rows, "k string, v int"), ["k"], "v", block).collect())
    assert got == [(a, b) for a in range(40) for b in range(a + 1, 40)]
    assert pairs.meet(spark.createDataFrame([], "k string, v int"), ["k"], "v", block).count() == 0

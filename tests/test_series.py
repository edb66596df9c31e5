"""Change points against exhaustive search, tests against published values, groups against a plain union-find."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from quillmetry.functions import special
from quillmetry.operators import changepoints as cp
from quillmetry.operators import fingerprints as fp


def brute(x: np.ndarray, penalty: float, min_size: int = 5, jump: int = 5) -> float:
    n = len(x)
    places = [p for p in range(jump, n, jump)]
    cost = lambda a, b: float(((x[a:b] - x[a:b].mean()) ** 2).sum())
    best = math.inf
    for k in range(4):
        for breaks in itertools.combinations(places, k):
            ends = [0, *breaks, n]
            if all(b - a >= min_size for a, b in itertools.pairwise(ends)):
                best = min(best, sum(cost(a, b) for a, b in itertools.pairwise(ends)) + penalty * k)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_pelt_is_optimal(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=45) + np.where(np.arange(45) >= 20, 2.0 * (seed % 3), 0)
    for penalty in (3.0, 8.0):
        breaks = cp.pelt(x, penalty)
        ends = [0, *breaks, len(x)]
        got = sum(float(((x[a:b] - x[a:b].mean()) ** 2).sum()) for a, b in itertools.pairwise(ends)) + penalty * len(breaks)
        if len(breaks) <= 3:
            assert got == pytest.approx(brute(x, penalty))


def test_bocpd_finds_a_shift_and_keeps_quiet():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=80), rng.normal(6, 1, 80)]
    assert any(abs(at - 80) <= 4 for at, _ in cp.bocpd(x))
    assert cp.bocpd(x[:5]) == []


def test_special_functions_match_tables():
    assert special.t_sf2(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert special.f_sf(4.10, 2, 10) == pytest.approx(0.05, abs=3e-4)
    assert special.chi2_sf(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert special.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.normal_sf2(1.96) == pytest.approx(0.05, abs=1e-4)
    assert special.kolmogorov_sf(1.358) == pytest.approx(0.05, abs=1e-3)


def test_cohens_d_edges():
    a = np.array
    assert special.cohens_d(a([]), a([1.0])) == 0.0
    assert special.cohens_d(a([1.0]), a([3.0])) == 2.0
    assert special.cohens_d(a([1.0, 1.0]), a([1.0, 1.0])) == 0.0


def test_bootstrap_is_seeded():
    a, b = np.arange(20.0), np.arange(20.0) + 3
    assert cp.bootstrap_ci(a, b) == cp.bootstrap_ci(a, b)
    lo, hi = cp.bootstrap_ci(a, b)
    assert lo < 3 < hi


def test_series_skips_short_and_flat(spark):
    rows = [(1, i, 5.0) for i in range(20)] + [(2, i, float(i)) for i in range(5)] + [(3, i, float(i % 7)) for i in range(20)] + [(None, 1, None)]
    s = cp.series(spark.createDataFrame(rows, "k bigint, o int, v double"), "k", ["o"], "v")
    assert {r.entity for r in s.select("entity").distinct().collect()} == {3}


def test_banded_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = [int(v) for v in rng.integers(0, 2**32, 4)]
    rows = []
    for i in range(120):
        bands = list(base)
        for _ in range(int(rng.integers(0, 5))):
            bands[int(rng.integers(4))] ^= 1 << int(rng.integers(32))
        rows.append((i, bands))
    got = {(r.a, r.b) for r in fp.near_pairs(spark.createDataFrame(rows, "id bigint, bands array<bigint>"), "id").collect()}
    first = {}
    for i, b in rows:
        first.setdefault(tuple(b), i)
    want = {(min(i, j), max(i, j)) for (x, i), (y, j) in itertools.combinations(first.items(), 2) if sum((p ^ q).bit_count() for p, q in zip(x, y)) <= 3}
    assert got == want


def test_connected_is_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2)) if a != b] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.component for r in fp.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {v: root(v) for v in parent}


def test_simhash_is_symmetric_and_stable():
    assert fp.simhash_bands("") == fp.simhash_bands("   ")
    assert fp.simhash_bands("a  b\nc") == fp.simhash_bands("a b c")
    assert all(0 <= b < 2**32 for b in fp.simhash_bands("the quick brown fox"))

"""Change-point detection on ordered series, one group per entity: PELT, Bayesian online detection, two-sample tests.

Series come in long form (entity, position, value). A group is one series; values that aren't finite take the median of
those that are, or 0 where none is. Results don't depend on the order of rows: a series is sorted by its position.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmetry.functions import special


def finite(values: np.ndarray) -> np.ndarray:
    good = np.isfinite(values)
    return np.where(good, values, np.median(values[good]) if good.any() else 0.0)


#: Longest series of the kernel cost: its table of pairs is quadratic.
MOST_KERNEL = 4000


def _kernel_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the kernel over every square of pairs from the origin."""
    n = len(x)
    if n > MOST_KERNEL:
        raise ValueError(f"the kernel cost takes series of {MOST_KERNEL} values at most")
    gaps = (x[:, None] - x[None, :]) ** 2
    middle = float(np.median(gaps[np.triu_indices(n, 1)]))
    kernel = np.exp(-np.clip(gaps / middle if middle > 0 else gaps, 1e-2, 1e2))
    np.fill_diagonal(kernel, 1.0)
    out = np.zeros((n + 1, n + 1))
    out[1:, 1:] = kernel.cumsum(0).cumsum(1)
    return out


def pelt(x: np.ndarray, penalty: float, min_size: int = 5, jump: int = 5, cost: str = "l2") -> list[int]:
    """Optimal breaks of a series by pruned dynamic programming over multiples of `jump`, penalised per break.

    l2: squared deviations from the segment's mean; l1: absolute deviations from its median; rbf: distances under a
    Gaussian kernel as wide as the median squared distance, from a table of all pairs (MOST_KERNEL values at most).
    """
    n = len(x)
    if n < 2 * min_size:
        return []
    if cost == "rbf":
        square = _kernel_sums(x)
    s1, s2 = np.r_[0, np.cumsum(x)], np.r_[0, np.cumsum(x * x)]

    def costs(starts: np.ndarray, end: int) -> np.ndarray:
        if cost == "l2":
            m = end - starts
            return s2[end] - s2[starts] - (s1[end] - s1[starts]) ** 2 / m
        if cost == "rbf":
            m = end - starts
            return m - (square[end, end] - square[starts, end] - square[end, starts] + square[starts, starts]) / m
        return np.array([np.abs(x[a:end] - np.median(x[a:end])).sum() for a in starts])

    ends = [e for e in range(0, n, jump) if e >= min_size] + [n]
    best, prev = np.zeros(n + 1), {}
    open_ = np.zeros(1, int)  # in ascending order
    for e in ends:
        m = int(np.searchsorted(open_, e - min_size, "right"))
        if not m:
            continue
        able, later = open_[:m], open_[m:]
        total = best[able] + costs(able, e) + penalty
        k = int(total.argmin())
        best[e], prev[e] = total[k], int(able[k])
        open_ = np.concatenate([able[total <= best[e] + penalty], later, [e]])
    out, at = [], n
    while at in prev and prev[at] > 0:
        at = prev[at]
        out.append(at)
    return out[::-1]


class RunLengths:
    """Posterior of the run length, one value at a time, under a constant hazard.

    student: unknown mean and variance (normal-inverse-gamma), the prior from the first ten values, or 80 where those are
    flat. normal: known variance, that of the first 80 values. The state is the posterior, the prior and the running sums.
    """

    def __init__(self, first: np.ndarray, hazard: float, predictive: str = "student", room: int = 64):
        self.mu0, spread = float(first[:10].mean()), float(first[:10].var())
        self.sigma2 = max(float(first[:80].var()), 1e-12)
        self.beta0 = 0.5 * (spread if spread >= 1e-12 else self.sigma2)
        self.hazard, self.predictive, self.t = hazard, predictive, 1
        self.log_pi = np.zeros(1)
        self.s1, self.s2 = np.zeros(room + 1), np.zeros(room + 1)
        self._grow(room)
        self.s1[1], self.s2[1] = first[0], first[0] ** 2

    def _grow(self, room: int) -> None:
        if room + 1 > len(self.s1):
            self.s1, self.s2 = (np.concatenate([s, np.zeros(room + 1 - len(s))]) for s in (self.s1, self.s2))
        k = np.arange(1, len(self.s1), dtype=float)
        self.k, self.alpha, self.kappa = k, 1 + k / 2, 1 + k
        self.norm = np.array([math.lgamma(a + 0.5) - math.lgamma(a) for a in self.alpha])

    def step(self, value: float) -> np.ndarray:
        """Take the next value; the log posterior of run lengths 0, 1, ..."""
        t = self.t
        if t + 1 >= len(self.s1):
            self._grow(2 * len(self.s1))
        k, total = self.k[:t], self.s1[t] - self.s1[t - 1 :: -1][:t]
        if self.predictive == "normal":
            inverse = 1 / (4 * self.sigma2) + k / self.sigma2
            mean, var = (self.mu0 / (4 * self.sigma2) + total / self.sigma2) / inverse, 1 / inverse + self.sigma2
            pred = -0.5 * (np.log(2 * math.pi * var) + (value - mean) ** 2 / var)
        else:
            m = total / k
            ss = np.maximum(self.s2[t] - self.s2[t - 1 :: -1][:t] - k * m * m, 0)
            kap, al = self.kappa[:t], self.alpha[:t]
            beta = self.beta0 + 0.5 * ss + 0.5 * k * (m - self.mu0) ** 2 / kap
            scale = np.maximum(beta * (kap + 1) / (al * kap), 1e-300)
            pred = self.norm[:t] - 0.5 * np.log(2 * al * math.pi * scale) - (al + 0.5) * np.log1p((value - (self.mu0 + k * m) / kap) ** 2 / (2 * al * scale))
        joint = self.log_pi + pred
        top = joint.max()
        new = np.concatenate([[math.log(self.hazard) + top + math.log(np.exp(joint - top).sum())], math.log1p(-self.hazard) + joint])
        top = new.max()
        self.log_pi = new - (top + math.log(np.exp(new - top).sum()))
        self.s1[t + 1], self.s2[t + 1] = self.s1[t] + value, self.s2[t] + value * value
        self.t = t + 1
        return self.log_pi


class Alarms:
    """Tells a change where the most probable run length falls under `drop` of the one before, once that was `min_run`."""

    def __init__(self, drop: float = 0.5, min_run: int = 5, cooldown: int = 3):
        self.drop, self.min_run, self.cooldown, self.before, self.last = drop, min_run, cooldown, 0, -(10**9)

    def see(self, t: int, log_pi: np.ndarray) -> float | None:
        now = int(log_pi.argmax())
        told = self.before >= self.min_run and now < self.drop * self.before and t - self.last >= self.cooldown
        self.before = now
        if not told:
            return None
        self.last = t
        return float(np.exp(log_pi[now]))


def merged(told: list[tuple[int, float]], within: int) -> list[tuple[int, float]]:
    """Runs of alarms each `within` places of the one before it, as the one of highest confidence; ties are the first."""
    runs: list[list[tuple[int, float]]] = []
    for x in told:
        if runs and x[0] - runs[-1][-1][0] <= within:
            runs[-1].append(x)
        else:
            runs.append([x])
    return [max(r, key=lambda z: z[1]) for r in runs]


def bocpd(x: np.ndarray, hazard: float = 1 / 250, drop: float = 0.5, min_run: int = 5, cooldown: int = 3, merge: int = 2, predictive: str = "student", read_out: str = "reset", threshold: float = 0.5) -> list[tuple[int, float]]:
    """Bayesian online detection over a whole series: place and confidence of each change.

    reset: falls of the most probable run length, with the posterior of the new one; alarms within `merge` are one.
    legacy: places where the probability of a new run reaches `threshold` (a constant hazard pins it to the hazard).
    """
    n = len(x)
    if n < (max(6, min_run + 2) if read_out == "reset" else 6):
        return []
    runs, alarms, told = RunLengths(x, hazard, predictive, n), Alarms(drop, min_run, cooldown), []
    for t in range(1, n):
        log_pi = runs.step(float(x[t]))
        p = alarms.see(t, log_pi) if read_out == "reset" else (float(np.exp(log_pi[0])) if np.exp(log_pi[0]) >= threshold else None)
        if p is not None:
            told.append((t, p))
    return merged(told, merge) if read_out == "reset" else told


def _alarms(xs: list[np.ndarray], hazard: np.ndarray, drop: float, min_run: int, cooldown: int) -> list[list[tuple[int, float]]]:
    """The alarms of several series, the longest first, under RunLengths' student posterior: a row of a matrix is a series.

    The predictive densities of a run's values multiply to the density of the whole run, which its sums give: the weight of
    the run of k values is, but for what all runs share, lgamma(1 + k / 2) - (1 + k / 2) log(beta) - log(1 + k) / 2. So a
    step takes one logarithm of each run. Runs stand by length, shortest first; sums are stored from the end.
    """
    m, n = len(xs), len(xs[0])
    size = np.array([len(x) for x in xs])
    spread, sigma2 = np.array([x[:10].var() for x in xs]), np.maximum([x[:80].var() for x in xs], 1e-12)
    beta0 = 0.5 * np.where(spread >= 1e-12, spread, sigma2)[:, None]
    y, s1, s2, start = np.zeros((m, n)), np.zeros((m, n + 1)), np.zeros((m, n + 1)), np.zeros((m, n))
    for i, x in enumerate(xs):
        y[i, : len(x)] = x - x[:10].mean()
    s1[:, :n], s2[:, :n] = np.cumsum(y, 1)[:, ::-1], np.cumsum(0.5 * y * y, 1)[:, ::-1]
    k = np.arange(1, n + 1, dtype=float)
    alpha, half = 1 + k / 2, 0.5 / (k + 1)
    grow, new = np.log1p(-hazard), np.log(hazard)
    shape = np.array([math.lgamma(a) for a in alpha]) - 0.5 * np.log1p(k) + (k - 1) * grow[:, None]
    first = shape[:, :1] - 1.5 * np.log(beta0 + 0.25 * y * y)  # a run of one value
    start[:, n - 1] = -first[:, 0]
    before, last, told = np.zeros(m, int), np.full(m, -(10**9)), [[] for _ in xs]
    room, more = np.empty((2, m, n))
    for t in range(1, n):
        r = int(np.searchsorted(-size, -t, "left"))  # series of more than t values
        u, v = room[:r, :t], more[:r, :t]
        np.subtract(s1[:r, n - 1 - t, None], s1[:r, n - t + 1 :], out=u)
        np.multiply(u, u, out=u)
        np.multiply(u, half[1 : t + 1], out=u)
        np.subtract(s2[:r, n - 1 - t, None], s2[:r, n - t + 1 :], out=v)
        np.subtract(v, u, out=v)
        np.maximum(v, 0, out=v)
        np.add(v, beta0[:r], out=v)
        np.log(v, out=v)
        np.multiply(v, alpha[1 : t + 1], out=v)
        np.subtract(shape[:r, 1 : t + 1], v, out=u)
        np.add(u, start[:r, n - t :], out=u)
        at = u.argmax(1)
        top = u[np.arange(r), at]
        np.subtract(u, top[:, None], out=u)
        np.exp(u, out=u)
        level = top + np.log(u.sum(1)) - grow[:r]
        start[:r, n - 1 - t] = new[:r] + level - first[:r, t]
        grown = top - level > new[:r]
        now = np.where(grown, at + 1, 0)
        for i in np.flatnonzero((before[:r] >= min_run) & (now < drop * before[:r]) & (t - last[:r] >= cooldown)):
            last[i] = t
            told[i].append((t, float(np.exp(top[i] - level[i] if grown[i] else new[i]))))
        before[:r] = now
    return told


def bocpd_many(xs: list[np.ndarray], hazards: list[float], drop: float = 0.5, min_run: int = 5, cooldown: int = 3, merge: int = 2, cells: int = 1 << 15) -> list[list[tuple[int, float]]]:
    """bocpd() of many series, several at a time: as many of like length as fill `cells` of a matrix."""
    out: list[list[tuple[int, float]]] = [[] for _ in xs]
    order = sorted((i for i, x in enumerate(xs) if len(x) >= max(6, min_run + 2)), key=lambda i: -len(xs[i]))
    while order:
        most = max(1, cells // len(xs[order[0]]))
        part, order = order[:most], order[most:]
        with np.errstate(all="ignore"):
            told = _alarms([xs[i] for i in part], np.array([hazards[i] for i in part]), drop, min_run, cooldown)
        for i, alarms in zip(part, told):
            out[i] = merged(alarms, merge)
    return out


def series(df: DataFrame, entity: str, order: list[str], value: str, least: int = 10) -> DataFrame:
    """entity, i, value of series long enough and not flat; both are decided before any Python runs."""
    w = Window.partitionBy(entity)
    out = df.select(F.col(entity).alias("entity"), *order, F.col(value).cast("double").alias("value"))
    out = out.withColumn("i", F.row_number().over(Window.partitionBy("entity").orderBy(*order)))
    w = Window.partitionBy("entity")
    return out.withColumns({"n": F.count("*").over(w), "sd": F.stddev_pop("value").over(w)}).filter((F.col("n") >= least) & (F.coalesce("sd", F.lit(0.0)) > 1e-9)).select("entity", "i", "value")


def per_series(df: DataFrame, f: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Apply a function of one ordered series to every series."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = finite(g.sort_values("i")["value"].to_numpy(float))
        return pd.DataFrame([(g["entity"].iloc[0], *r) for r in f(x)], columns=names)

    return df.groupBy("entity").applyInPandas(run, schema)


def break_rows(x: np.ndarray, breaks: list[tuple[int, float | None]]) -> list[tuple]:
    """Of each break the standardised difference of the whole series after it and before it, direction and confidence."""
    out = []
    for at, p in breaks:
        a, b = special.moments(x[:at]), special.moments(x[at:])
        d = special.effect(a, b)
        out.append((at, d, "increase" if b[1] >= a[1] else "decrease", abs(d) / (abs(d) + 1) if p is None else p))
    return out


BREAKS = "entity bigint, at int, d double, direction string, confidence double"


def pelt_breaks(s: DataFrame, penalty: float = 5.0, cost: str = "l2") -> DataFrame:
    return per_series(s, lambda x: break_rows(x, [(b, None) for b in pelt(x, penalty * float(x.std()), cost=cost)]), BREAKS)


def bocpd_breaks(s: DataFrame, hazard: float = 1 / 250) -> DataFrame:
    return per_series(s, lambda x: break_rows(x, bocpd(x, hazard)), BREAKS)


def evidence_gate(breaks: DataFrame, method: str, least_d: float = 0.5, least_p: float = 0.9) -> DataFrame:
    """PELT's breaks by effect alone, the others by effect and confidence."""
    d = F.abs("d")
    return breaks.filter(d >= max(least_d, 1.0) if method == "pelt" else (d >= least_d) & (F.col("confidence") >= least_p))


def bootstrap_ci(a: np.ndarray, b: np.ndarray, n: int = 1000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float]:
    """Percentile interval of the difference of means, from a seeded generator: all draws of the first side come first."""
    if not len(a) or not len(b):
        return 0.0, 0.0
    rng = np.random.default_rng(seed)
    gaps = -a[rng.integers(0, len(a), (n, len(a)))].mean(1)
    gaps += b[rng.integers(0, len(b), (n, len(b)))].mean(1)
    lo, hi = np.percentile(gaps, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(lo), float(hi)


#: Numbers of a matrix of draws, and series that are drawn for at once. Fewer series than _FEW look their draws up.
_CELLS, _SERIES, _FEW = 1 << 18, 512, 3


def bootstrap_cis(splits: list[tuple[np.ndarray, int]], n: int = 1000, alpha: float = 0.05, seed: int = 42) -> list[tuple[float, float]]:
    """bootstrap_ci() of many series, each split at a place inside, with the same draws.

    The draws hang on the two sides' sizes alone. So they are made once for all splits of the same sizes, as a table of how
    often each place is drawn, and the means of all these series are one product of matrices.
    """

    def means(rng: np.random.Generator, sides: np.ndarray) -> np.ndarray:
        size, many = sides.shape
        out = np.empty((n, many))
        step = max(1, _CELLS // size)
        for lo in range(0, n, step):
            rows = min(step, n - lo)
            drawn = rng.integers(0, size, (rows, size))
            if many < _FEW:
                for j in range(many):
                    out[lo : lo + rows, j] = sides[:, j].take(drawn).mean(1)
            else:
                drawn += np.arange(rows)[:, None] * size
                out[lo : lo + rows] = np.bincount(drawn.ravel(), minlength=rows * size).reshape(rows, size).astype(float) @ sides / size
        return out

    out: list[tuple[float, float]] = [(0.0, 0.0)] * len(splits)
    order = sorted(range(len(splits)), key=lambda i: (splits[i][1], len(splits[i][0])))
    for k, of_k in groupby(order, key=lambda i: splits[i][1]):
        of_k = list(of_k)
        for lo in range(0, len(of_k), _SERIES):
            part = of_k[lo : lo + _SERIES]
            rng = np.random.default_rng(seed)
            before = means(rng, np.column_stack([splits[i][0][:k] for i in part]))
            state = rng.bit_generator.state
            for _, same in groupby(range(len(part)), key=lambda j: len(splits[part[j]][0])):
                same = list(same)
                rng.bit_generator.state = state
                gaps = means(rng, np.column_stack([splits[part[j]][0][k:] for j in same])) - before[:, same]
                for j, lo_hi in zip(same, np.percentile(gaps, [100 * alpha / 2, 100 * (1 - alpha / 2)], axis=0).T.tolist()):
                    out[part[j]] = tuple(lo_hi)
    return out


def two_samples(x: np.ndarray, cuts: list[int]) -> list[list[tuple[str, float, float]]]:
    """At each cut of a series, of its parts before and after: Welch's t, Mann-Whitney U (exact for a side of eight at most without ties, else normal with ties and continuity) and Kolmogorov-Smirnov: name, statistic, p. The series is ranked once."""
    n, out = len(x), []
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    upto = np.cumsum(counts)
    ranks = (upto - (counts - 1) / 2)[inverse]
    order, ties = np.argsort(inverse, kind="stable"), (counts**3 - counts).sum()
    for na in cuts:
        nb = n - na
        (_, ma, va), (_, mb, vb) = special.moments(x[:na]), special.moments(x[na:])
        q = va / na + vb / nb
        t = (mb - ma) / math.sqrt(q) if q > 0 else 0.0
        df = q * q / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)) if q > 0 else 1.0
        u = ranks[na:].sum() - nb * (nb + 1) / 2
        sd = math.sqrt(na * nb / 12 * ((n + 1) - ties / (n * (n - 1))))
        z = max(0.0, abs(u - na * nb / 2) - 0.5) / sd if sd > 0 else 0.0
        exact = min(na, nb) <= 8 and len(counts) == n  # a small side without ties
        first = np.cumsum(order < na)[upto - 1]
        ks = np.abs(first / na - (upto - first) / nb).max()
        out.append([("welch", float(t), special.t_sf2(float(t), float(df)) if q > 0 else 1.0), ("mann_whitney", float(u), special.u_exact_sf2(float(u), na, nb) if exact else special.normal_sf2(z)), ("ks", float(ks), special.kolmogorov_sf(float(ks) * math.sqrt(na * nb / n)))])
    return out


def two_sample(a: np.ndarray, b: np.ndarray) -> list[tuple[str, float, float]]:
    """two_samples() of two sides."""
    return two_samples(np.concatenate([a, b]), [len(a)])[0]


TESTS = "entity bigint, at int, test string, statistic double, p double, d double, ci_lo double, ci_hi double, skipped string"


def split_tests(s: DataFrame, at: Callable[[np.ndarray], int], least: int = 10, seed: int = 42) -> DataFrame:
    """The two-sample tests of each series at a split, with effect and interval; short sides give a row with the reason."""

    def f(x: np.ndarray) -> list[tuple]:
        k = at(x)
        a, b = x[:k], x[k:]
        if len(x) < 4 or len(a) < least or len(b) < least:
            return [(k, "none", None, None, None, None, None, "short_segment")]
        lo, hi = bootstrap_ci(a, b, seed=seed)
        return [(k, name, stat, p, special.cohens_d(a, b), lo, hi, None) for name, stat, p in two_sample(a, b)]

    return per_series(s, f, TESTS)


def cluster_permutation(s: DataFrame, threshold: float, n: int = 1000, seed: int = 42) -> DataFrame:
    """How dense a series' alarms stand in a tenth of it, against as many places drawn at random: density, null's mean, p."""

    def density(idx: np.ndarray, window: int) -> int:
        return int((np.searchsorted(idx, idx + window, "left") - np.arange(len(idx))).max()) if len(idx) else 0

    def f(x: np.ndarray) -> list[tuple]:
        alarms = np.flatnonzero(x > threshold)
        rng = np.random.default_rng(seed)
        window = max(1, len(x) // 10)
        null = np.array([density(np.sort(rng.choice(len(x), len(alarms), replace=False)), window) for _ in range(n)])
        seen = density(alarms, window)
        return [(seen, float(null.mean()), float(((null >= seen).sum() + 1) / (n + 1)))]

    return per_series(s, f, "entity bigint, density int, null_mean double, p double")


def decompose(x: np.ndarray, period: int = 30) -> list[tuple]:
    """Trend by a centred moving mean with padded edges, seasonal part by place in the period, and the rest."""
    n = len(x)
    p = max(3, min(period, max(3, n // 2)))
    padded = np.pad(x, p // 2, mode="edge")
    trend = np.convolve(padded, np.ones(p) / p, "valid")[:n]
    place = np.arange(n) % p
    seasonal = (np.bincount(place, weights=x - trend) / np.bincount(place))[place]
    return [(i + 1, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(trend, seasonal, x - trend - seasonal))]


def null_breaks(entities: DataFrame, length: int = 500, penalty: float = 5.0, seed: int = 42) -> DataFrame:
    """entities: entity. Breaks that PELT finds in one series of normal values per entity, drawn from a seed of its own."""

    def run(batches):
        for b in batches:
            out = []
            for e in b["entity"]:
                x = np.random.default_rng([seed, int(e)]).normal(size=length)
                out.append(len(pelt(x, penalty * float(x.std()))))
            yield pd.DataFrame({"entity": b["entity"], "breaks": out})

    return entities.select("entity").mapInPandas(run, "entity bigint, breaks int")

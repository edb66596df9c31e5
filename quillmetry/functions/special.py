"""Special functions for p-values, in NumPy and the standard library."""

from __future__ import annotations

import math

import numpy as np


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def gamma_inc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def t_sf2(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else math.nan


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_sf(x: float, df: float) -> float:
    return gamma_inc_upper(df / 2, x / 2)


def normal_sf2(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def u_exact_sf2(u: float, m: int, n: int) -> float:
    """Two-sided exact p of the rank-sum statistic without ties, from the number of ways to reach each value."""
    if m > n:
        m, n = n, m
    ways = np.zeros(m * n + 1)
    ways[0] = 1.0
    for i in range(1, m + 1):
        ways[n + i :] -= ways[: -(n + i)].copy() if n + i < len(ways) else 0.0  # times 1 - x**(n + i)
        for r in range(i):
            ways[r::i] = np.cumsum(ways[r::i])  # by 1 - x**i
    top = int(math.ceil(max(u, m * n - u)))
    return float(min(1.0, 2 * ways[top:].sum() / ways.sum()))


def bh(p: list[float]) -> list[float]:
    """Benjamini-Hochberg of a short list, in its order."""
    x = np.asarray(p, float)
    order = np.argsort(-x, kind="stable")
    out = np.empty(len(x))
    out[order] = np.minimum(1.0, np.minimum.accumulate(x[order] * len(x) / np.arange(len(x), 0, -1)))
    return out.tolist()


def kolmogorov_sf(x: float) -> float:
    """Asymptotic survival function of the two-sample statistic."""
    if x < 0.2:
        return 1.0
    most = min(100, int(math.sqrt(373) / x) + 1)  # later terms are 0 in double precision
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, most + 1))))


def moments(x: np.ndarray) -> tuple[int, float, float | None]:
    """Number, mean and variance of the values; one value has no variance."""
    n = len(x)
    mean = np.add.reduce(x) / n
    gaps = x - mean
    return n, float(mean), float(np.add.reduce(gaps * gaps) / (n - 1)) if n > 1 else None


def effect(a: tuple[int, float, float | None], b: tuple[int, float, float | None]) -> float:
    """Difference of means by the pooled deviation, from the moments of both sides; a side of one value takes the other's, two of one the raw difference."""
    (na, ma, va), (nb, mb, vb) = a, b
    gap = mb - ma
    if na < 2 and nb < 2:
        return gap
    va, vb = (va if va is not None else vb), (vb if vb is not None else va)
    pooled = math.sqrt(((na - 1) * va + (nb - 1) * vb) / max(1, na + nb - 2)) if na + nb > 2 else math.sqrt(va)
    return gap / pooled if pooled > 1e-12 and math.isfinite(pooled) else 0.0


def cohens_d(a: np.ndarray, b: np.ndarray) -> float:
    """effect() of two sides, 0 where one is empty."""
    return effect(moments(a), moments(b)) if len(a) and len(b) else 0.0

"""Scalar statistics on the driver: tail probabilities and quantiles that need no data."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

EXACT_KS_ROWS = 10_000


def chi2_tail(x: float, dof: int) -> float:
    """P(X >= x) of a chi-square variable with an integer number of degrees of freedom."""
    if dof <= 0 or x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    # Q(k/2, x/2) by its recurrence from the one- and two-degree cases, in logarithms.
    half = x / 2
    if dof % 2:
        total, a = math.erfc(math.sqrt(half)), 0.5
    else:
        total, a = math.exp(-half), 1.0
    while a < dof / 2 - 1e-9:
        total += math.exp(a * math.log(half) - half - math.lgamma(a + 1))
        a += 1
    return min(1.0, total)


def kolmogorov_tail(t: float) -> float:
    """The limit distribution's P(K >= t)."""
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * t) ** 2) for k in range(1, 101))))


def ks_tail_exact(d: float, m: int, n: int) -> float:
    """P(D >= d) of the two-sample statistic for sizes m and n: lattice paths that leave the band.

    Paths are counted as probabilities, one anti-diagonal i + j at a time, within the band.
    """
    if m < n:
        m, n = n, m
    h = round(d * m * n / math.gcd(m, n)) * math.gcd(m, n)
    if h <= 0:
        return 1.0
    # inside[j + 1]: probability that a random path reaches (i, j) and stayed where |i n - j m| < h.
    inside = np.zeros(n + 2)
    inside[1] = 1.0
    before = 0, 1
    for s in range(1, m + n + 1):
        low = max(0, s - m, (s * n - h) // (m + n) + 1)
        high = min(n, s, -((-s * n - h) // (m + n)) - 1)
        j = np.arange(low, high + 1)
        # A path to (i, j) came from (i - 1, j) with the share i / s.
        row = (inside[low + 1 : high + 2] * (s - j) + inside[low : high + 1] * j) / s
        inside[before[0] + 1 : before[1] + 1] = 0.0
        inside[low + 1 : high + 2] = row
        before = low, high + 1
    return float(min(1.0, max(0.0, 1.0 - inside[n + 1])))


def ks_tail(d: float, m: int, n: int) -> float:
    """Two-sided p-value: exact up to 10,000 rows a side, the limit beyond."""
    if max(m, n) <= EXACT_KS_ROWS:
        return ks_tail_exact(d, m, n)
    return kolmogorov_tail(d * math.sqrt(m * n / (m + n)))


def normal_threshold(p: float, n: int, quantile: float) -> dict:
    """Quantile of N(p, p(1-p)/n), and whether npq is large enough for it (10 at least)."""
    variance = p * (1 - p) / n
    std = math.sqrt(max(variance, 0.0))
    value = NormalDist(p, std).inv_cdf(quantile) if std > 0 else p
    npq = n * p * (1 - p)
    return {"family": "normal", "mean": p, "variance": variance, "std": std, "n": n, "npq": npq, "threshold": value, "normal_approximation_reliable": npq >= 10}


def size_corrected(p: float) -> float:
    """What a share measured on half the rows is expected to be on all of them: 1 - (1 - p)**2."""
    return 1 - (1 - p) ** 2

"""Paired tests with numpy only: Student's t by the incomplete beta function, Wilcoxon's signed ranks."""

from __future__ import annotations

import math

import numpy as np


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + step * d or tiny)
        c = 1.0 + step / c or tiny
        f *= c * d
        if i and abs(1.0 - c * d) < 1e-14:
            break
    return front * (f - 1.0)


def t_two_sided(t: float, freedom: int) -> float:
    return incomplete_beta(freedom / 2.0, 0.5, freedom / (freedom + t * t))


def average_ranks(values: np.ndarray) -> np.ndarray:
    _, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    return ((ends - counts + 1 + ends) / 2.0)[inverse]


def wilcoxon(differences: np.ndarray) -> tuple[float, float]:
    """(smaller rank sum, two-sided p): exact up to 50 pairs without zeros or ties, else by the normal curve."""
    d = differences[differences != 0]
    n = len(d)
    if not n:
        return 0.0, 1.0
    ranks = average_ranks(np.abs(d))
    low = float(min(ranks[d > 0].sum(), ranks[d < 0].sum()))
    if n <= 50 and n == len(differences) and len(np.unique(ranks)) == n:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return low, float(min(1.0, 2 * ways[: int(low) + 1].sum() / 2.0**n))
    ties = np.unique(ranks, return_counts=True)[1].astype(float)
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - (ties**3 - ties).sum() / 48.0
    z = (low - n * (n + 1) / 4.0) / math.sqrt(variance) if variance > 0 else 0.0
    return low, float(min(1.0, math.erfc(abs(z) / math.sqrt(2))))


def paired_pvalues(differences: np.ndarray) -> dict[str, float | None]:
    """paired_t_p, wilcoxon_stat and wilcoxon_p; null with fewer than two pairs."""
    d = np.asarray(differences, float)
    d = d[np.isfinite(d)]
    n = len(d)
    if n < 2:
        return {"paired_t_p": None, "wilcoxon_stat": None, "wilcoxon_p": None}
    deviation = d.std(ddof=1)
    p = t_two_sided(d.mean() / (deviation / math.sqrt(n)), n - 1) if deviation > 0 else None
    low, w = wilcoxon(d)
    return {"paired_t_p": p, "wilcoxon_stat": low, "wilcoxon_p": w}

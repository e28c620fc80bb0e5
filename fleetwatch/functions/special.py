"""NumPy special functions (SciPy is not a dependency). All work on whole arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _betacf(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, rounds + 1):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / guard(1.0 + num * d)
            c = guard(1.0 + num / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def beta_cdf(x, a, b) -> np.ndarray:
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = inner < (a + 1) / (a + b + 2)
    left = front * _betacf(a, b, np.where(low, inner, 0.0)) / a
    right = 1.0 - front * _betacf(b, a, np.where(low, 0.0, 1.0 - inner)) / b
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(low, left, right)))


def beta_ppf(q: float, a: pd.Series, b: pd.Series) -> pd.Series:
    """Quantile by bisection, for a whole batch at once."""
    av, bv = a.to_numpy(float), b.to_numpy(float)
    lo, hi = np.zeros_like(av), np.ones_like(av)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = beta_cdf(mid, av, bv) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return pd.Series((lo + hi) / 2, index=a.index)


def ks_2sample(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two-sample KS distance and its asymptotic p-value; both samples sorted."""
    n, m = len(x), len(y)
    grid = np.concatenate([x, y])
    d = float(np.max(np.abs(np.searchsorted(x, grid, "right") / n - np.searchsorted(y, grid, "right") / m)))
    return d, kolmogorov_sf(d * math.sqrt(n * m / (n + m)))


def kolmogorov_sf(t: float) -> float:
    if t < 0.2:
        return 1.0
    k = np.arange(1, 101)
    return float(np.clip(2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k * k * t * t)), 0, 1))


# Scholz-Stephens (1987) critical values b0 + b1/sqrt(m) + b2/m for the
# k-sample Anderson-Darling statistic at levels .25 .10 .05 .025 .01 .005 .001.
_AD_LEVELS = np.array([0.25, 0.1, 0.05, 0.025, 0.01, 0.005, 0.001])
_AD_B0 = np.array([0.675, 1.281, 1.645, 1.96, 2.326, 2.573, 3.085])
_AD_B1 = np.array([-0.245, 0.25, 0.678, 1.149, 1.822, 2.364, 3.615])
_AD_B2 = np.array([-0.105, -0.305, -0.362, -0.391, -0.396, -0.345, -0.154])


def ad_2sample(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two-sample Anderson-Darling statistic (midrank form) and its p in [.001, .25]."""
    samples = (np.sort(x), np.sort(y))
    z = np.sort(np.concatenate(samples))
    zs, ties = np.unique(z, return_counts=True)
    total, k = len(z), 2
    upto = np.searchsorted(z, zs, "left") + ties / 2.0
    a2 = 0.0
    for s in samples:
        right = np.searchsorted(s, zs, "right")
        own = right - np.searchsorted(s, zs, "left")
        m = right - own / 2.0
        den = upto * (total - upto) - total * ties / 4.0
        a2 += float(np.sum(ties / total * (total * m - upto * len(s)) ** 2 / den)) / len(s)
    a2 *= (total - 1.0) / total
    inv = sum(1.0 / len(s) for s in samples)
    hs = 1.0 / np.arange(total - 1, 1, -1)
    csum = np.cumsum(hs)
    h = csum[-1] + 1
    g = float(np.sum(csum / np.arange(2, total)))
    ca = (4 * g - 6) * (k - 1) + (10 - 6 * g) * inv
    cb = (2 * g - 4) * k**2 + 8 * h * k + (2 * g - 14 * h - 4) * inv - 8 * h + 4 * g - 6
    cc = (6 * h + 2 * g - 2) * k**2 + (4 * h - 4 * g + 6) * k + (2 * h - 6) * inv + 4 * h
    cd = (2 * h + 6) * k**2 - 4 * h * k
    var = (ca * total**3 + cb * total**2 + cc * total + cd) / ((total - 1.0) * (total - 2.0) * (total - 3.0))
    m = k - 1
    stat = (a2 - m) / math.sqrt(var)
    crit = _AD_B0 + _AD_B1 / math.sqrt(m) + _AD_B2 / m
    if stat < crit[0]:
        return stat, 0.25
    if stat > crit[-1]:
        return stat, 0.001
    fit = np.polyfit(crit, np.log(_AD_LEVELS), 2)
    return stat, float(math.exp(np.polyval(fit, stat)))

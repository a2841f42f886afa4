"""Distribution functions for the small solves on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

_TINY = 1e-300


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > _TINY else _TINY)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > _TINY else _TINY)
            c = 1 + num / c
            c = c if abs(c) > _TINY else _TINY
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def gamma_sf(a: float, x: float) -> float:
    """1 minus the regularised lower incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def f_sf(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if math.isfinite(f) else 0.0


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def t_quantile(p: float, df: float) -> float:
    """By bisection on the two-sided tail."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while t_two_sided(high, df) / 2 > 1 - p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if t_two_sided(mid, df) / 2 > 1 - p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided p of U without ties, from counts of arrangements."""
    counts = [1] + [0] * (n1 * n2)
    for k in range(1, n1 + 1):  # multiply by (1 - q^(n2 + k)) / (1 - q^k)
        for i in range(len(counts) - 1, n2 + k - 1, -1):
            counts[i] -= counts[i - n2 - k]
        for i in range(k, len(counts)):
            counts[i] += counts[i - k]
    total = math.comb(n1 + n2, n1)
    upper = max(u, n1 * n2 - u)
    return min(1.0, 2 * sum(counts[math.ceil(upper) :]) / total)

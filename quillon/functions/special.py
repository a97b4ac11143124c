"""Special functions that Spark SQL lacks, for small driver-side tables."""

from __future__ import annotations

import math
from statistics import NormalDist


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function: its continued fraction, evaluated from the tail."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    terms = 60 + int(4 * math.sqrt(max(a, b)))
    value = 1.0
    for i in range(terms, 0, -1):
        m = i // 2
        if i % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1 + term / value
    return min(1.0, max(0.0, front / value))


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if df <= 0 or math.isnan(t):
        return 1.0
    if math.isinf(t):
        return 0.0
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    if f <= 0 or d1 <= 0 or d2 <= 0:
        return 1.0
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_critical(alpha: float, df: float) -> float:
    """The t whose two-sided p-value is alpha, by bisection."""
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > alpha and hi < 1e9:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > alpha else (lo, mid)
    return (lo + hi) / 2


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def probit(p: float) -> float:
    """Inverse of the standard normal distribution function."""
    return NormalDist().inv_cdf(min(1 - 1e-15, max(1e-15, p)))


def correlation_p(r: float, n: float) -> float:
    """Two-sided p-value of a Pearson r over n rows."""
    if n <= 2:
        return 1.0
    if abs(r) >= 0.9999999:
        return 0.0
    df = n - 2
    return t_two_sided(abs(r) * math.sqrt(df / (1 - r * r)), df)

"""Distribution tails that Spark SQL has no functions for, on Arrow batches."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below x = a + 1, Lentz' continued fraction from there on. Some sqrt(a) terms do."""
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    tiny, b = 1e-300, x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    value, k = d, 0
    while True:
        k += 1
        b += 2.0
        top = -k * (k - a)
        d = 1.0 / ((top * d + b) or tiny)
        c = (b + top / c) or tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15 or k > 100_000_000:
            return min(1.0, front * value)


def _poisson_cdf(n: int, rate: float) -> float:
    """P(X <= n)."""
    if n < 0:
        return 0.0
    return 1.0 if rate <= 0 else _gamma_upper(n + 1.0, rate)


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz' continued fraction."""
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 / max(1e-300, 1.0 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 3000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            c = 1.0 + top / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return min(1.0, front * value)


def _binomial_sf(hits: int, n: int, p: float) -> float:
    """P(X >= hits)."""
    if hits <= 0:
        return 1.0
    if p <= 0 or hits > n:
        return 0.0
    return 1.0 if p >= 1 else _beta_tail(hits, n - hits + 1, p)


def poisson_cdf(n: Column, rate: Column) -> Column:
    def run(n: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series([_poisson_cdf(int(a), float(b)) for a, b in zip(n, rate, strict=True)])

    return F.pandas_udf(run, "double")(n, rate)


def binomial_sf(hits: Column, n: Column, p: Column) -> Column:
    def run(hits: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([_binomial_sf(int(a), int(b), float(c)) for a, b, c in zip(hits, n, p, strict=True)])

    return F.pandas_udf(run, "double")(hits, n, p)


def critical_hits(n: int, tau: float, alpha: float) -> int | None:
    """The fewest hits with a tail of at most alpha; none if even n hits have more. Tails fall with the hits, so the place is found by halving."""
    if _binomial_sf(n, n, tau) > alpha:
        return None
    few, enough = -1, n
    while enough - few > 1:
        mid = (few + enough) // 2
        few, enough = (few, mid) if _binomial_sf(mid, n, tau) <= alpha else (mid, enough)
    return enough


def power_at_gain(n: int, tau: float, gain: float, alpha: float) -> float:
    c = critical_hits(n, tau, alpha)
    return 0.0 if c is None else _binomial_sf(c, n, min(1.0, gain * tau))


def events_needed(tau: float, gain: float, alpha: float, power: float, cap: int = 2_000_000) -> int | None:
    """The fewest events at which the power is reached; none up to the cap. With every hit more that is required the power falls back, in teeth as long as a hit takes events to come by,
    so each tooth is asked at its end, where it is highest, and the first one that reaches the power is walked through."""
    reaches = lambda n: power_at_gain(n, tau, gain, alpha) >= power
    start, c = 1, None
    while start <= cap:
        c = critical_hits(start, tau, alpha)
        low, high = start, start + 1
        while high <= cap and critical_hits(high, tau, alpha) == c:
            low, high = high, 2 * high - start
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if critical_hits(mid, tau, alpha) == c else (low, mid)
        end = min(low, cap)
        if c is not None and reaches(end):
            few, enough = start - 1, end
            while enough - few > 1:
                mid = (few + enough) // 2
                few, enough = (few, mid) if reaches(mid) else (mid, enough)
            return enough
        start = end + 1
    return None

"""Exact chances from log-gamma, one number a group: no array as long as the group."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method; its steps grow with the root of a + b."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h, m = d, 1
    while True:
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-14 or m > 10_000_000:
            return h
        m += 1


def binomial_at_least(n: int, k: int, p: float) -> float:
    """P(X >= k) of n trials at rate p: the regularised incomplete beta function of (k, n - k + 1) at p."""
    if k <= 0:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    a, b = k, n - k + 1
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(p) + b * math.log1p(-p))
    # The fraction converges fast on one side of the mean; the other side is its complement.
    if p < (a + 1) / (a + b + 2):
        return min(1.0, front * _beta_fraction(a, b, p) / a)
    return max(0.0, 1 - front * _beta_fraction(b, a, 1 - p) / b)


def meets(n: int, k: int, m: int) -> float:
    """P(a random k-subset of n meets m marked places) = 1 - C(n - m, k) / C(n, k)."""
    if m <= 0 or k <= 0:
        return 0.0
    if k > n - m:
        return 1.0
    return -math.expm1(math.lgamma(n - m + 1) - math.lgamma(n - m - k + 1) - math.lgamma(n + 1) + math.lgamma(n - k + 1))


def _each(f, *cols: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(x) for x in row) else f(*row) for row in zip(*cols, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def binomial_tail(n: pd.Series, k: pd.Series, p: pd.Series) -> pd.Series:
    """P(X >= k) of a binomial, for counts of any size; null where an argument is."""
    return _each(binomial_at_least, n, k, p)


@F.pandas_udf(T.DoubleType())
def permutation_p(n: pd.Series, k: pd.Series, m: pd.Series) -> pd.Series:
    """Chance that k random places of n meet one of m marked ones; 0 for m = 0 or k = 0, 1 if unavoidable; null where an argument is."""
    return _each(meets, n, k, m)

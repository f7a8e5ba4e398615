"""Binomial tails, vectorised; Spark has no such function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction (Lentz's method)."""
    x, a, b = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(x, a, b))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    inside = (z > 0) & (z < 1)
    z0 = np.where(inside, z, 0.5)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z0) + q * np.log1p(-z0)) / p
    c = np.ones_like(z0)
    d = 1 - (p + q) * z0 / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for numerator in (m * (q - m) * z0 / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z0 / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + numerator / np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    value = np.where(inside, front * h, np.where(z <= 0, 0.0, 1.0))
    return np.where(swap, 1 - value, value)


def upper_tail(s: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P[X > s] for X ~ Bin(n, p)."""
    s, n, p = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(s, n, p))
    inside = (s >= 0) & (s < n)
    k, m = np.where(inside, s, 0.0), np.where(inside, n, 1.0)
    return np.where(s < 0, 1.0, np.where(s >= n, 0.0, incomplete_beta(np.clip(p, 0, 1), k + 1, m - k)))


def log_pmf(s: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """ln P[X = s]."""
    s, n, p = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(s, n, p))
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(s > 0, s * np.log(p), 0.0) + np.where(n - s > 0, (n - s) * np.log1p(-p), 0.0)
        return np.where((s < 0) | (s > n), -np.inf, _lgamma(n + 1) - _lgamma(np.maximum(s, 0) + 1) - _lgamma(np.maximum(n - s, 0) + 1) + parts)


@F.pandas_udf(DoubleType())
def binomial_upper(s: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P[X > s]; null in, null out."""
    return pd.Series(upper_tail(s.astype(float), n.astype(float), p.astype(float))).where(s.notna() & n.notna() & p.notna())


@F.pandas_udf(DoubleType())
def binomial_cdf(s: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """P[X <= s]."""
    return pd.Series(1 - upper_tail(s.astype(float), n.astype(float), p.astype(float))).where(s.notna() & n.notna() & p.notna())


@F.pandas_udf(DoubleType())
def binomial_minus_log(s: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """-ln P[X = s]."""
    return pd.Series(-log_pmf(s.astype(float), n.astype(float), p.astype(float))).where(s.notna() & n.notna() & p.notna())

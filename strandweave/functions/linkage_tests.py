"""Tests on 2x2 tables o11, o12, o21, o22 of two minors and the reads that cover both positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binomial import binomial_cdf, binomial_upper

#: Fixed values.
LONG_READ_ERROR = 0.1
SHORT_READ_ERROR = 0.2
EDGE_P = 1e-7
TINY_P = 1e-12
LEAST_NON_EDGE_RATE = 0.01


def fits_threshold(hits: Column, reads: Column, least: int, share: float) -> Column:
    """At least `least` hits, and more than that share of the reads."""
    return (hits >= least) & F.coalesce(F.try_divide(hits, reads) > share, F.lit(False))


def far_enough(p: Column, q: Column, close: int) -> Column:
    return F.abs(p - q) > close


def ratio(o11: Column, o12: Column, o21: Column, o22: Column, e: float) -> Column:
    """o22 against what errors would give; infinite where that is 0."""
    below = F.lit(e) * o11 + F.lit(1 - e) * (o12 + o21)
    return F.when(below == 0, F.lit(float("inf"))).otherwise(o22 / F.nullif(below, F.lit(0.0)))


def swapped(o11: Column, o22: Column) -> tuple[Column, Column]:
    """o11 and o22, exchanged where o11 is 0."""
    return F.when(o11 == 0, o22).otherwise(o11), F.when(o11 == 0, o11).otherwise(o22)


def chance(o11: Column, o12: Column, o21: Column, reads: Column) -> Column:
    """The expected rate of joint errors; infinite where o11 or reads is 0 and there are such reads."""
    below = o11 * reads
    return F.when(below == 0, F.when(o12 * o21 == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(o12 * o21 / F.nullif(below.cast("double"), F.lit(0.0)))


def edge_limit(length: int) -> float:
    """The p-value that counts, for all pairs of a reference of that length."""
    return EDGE_P / (length * (length - 1) / 2)


def has_edge(o11: Column, o12: Column, o21: Column, o22: Column, reads: Column, length: int, e: float, use_ratio: Column | None = None) -> Column:
    """Linked: the joint rate is beyond chance, or above what errors of rate e explain."""
    p = chance(o11, o12, o21, reads)
    by_ratio = ratio(o11, o12, o21, o22, e) > e
    if use_ratio is not None:
        by_ratio = use_ratio & by_ratio
    tail = binomial_upper(o22.cast("double"), reads.cast("double"), F.least(p, F.lit(1.0)))
    return F.when(p > 1, False).when(p < TINY_P, True).otherwise((tail < edge_limit(length)) | by_ratio)


def zero_cell_edge(o11: Column, o12: Column, o21: Column, o22: Column, e: float) -> Column:
    """For o12 or o21 of 0: linked unless errors of rate e explain it."""
    return ~(ratio(o11, o12, o21, o22, e) < e)


def short_read_edge(o11: Column, o12: Column, o21: Column, o22: Column, reads: Column, length: int, e: float = SHORT_READ_ERROR, use_ratio: Column | None = None) -> Column:
    a, b = swapped(o11, o22)
    return F.when((o12 == 0) | (o21 == 0), zero_cell_edge(o11, o12, o21, o22, e)).otherwise(has_edge(a, o12, o21, b, reads, length, e, use_ratio))


def edge_p(o11: Column, o12: Column, o21: Column, o22: Column, reads: Column, e: float) -> Column:
    """1 beyond chance, 0 where the ratio or the rate settles it, else the tail."""
    a, b = swapped(o11, o22)
    p = chance(a, o12, o21, reads)
    tail = binomial_upper(b.cast("double"), reads.cast("double"), F.least(p, F.lit(1.0)))
    return F.when(p > 1, 1.0).when(ratio(a, o12, o21, b, e) > e, 0.0).when(p < TINY_P, 0.0).otherwise(tail)


def non_edge_p(o11: Column, o22: Column, reads: Column, rate: float) -> Column:
    """P[X <= o22] at the rate that a true link would have at least."""
    _, b = swapped(o11, o22)
    return binomial_cdf(b.cast("double"), reads.cast("double"), F.lit(max(LEAST_NON_EDGE_RATE, rate)))

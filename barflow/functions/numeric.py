"""Scalar numeric helpers as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def clean_value(x: Column, default: float = 0.0) -> Column:
    """NULL, NaN and infinities become ``default``."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(INF))
    return F.when(bad, F.lit(default)).otherwise(x)


def null_if_bad(x: Column) -> Column:
    """NaN and infinities become NULL: the form every source delivers."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(INF)), x)


def bucket_score(x: Column, low_bad: float, low_ok: float, high_ok: float, high_bad: float,
                 compat: bool = False) -> Column:
    """-2, -1, 0, 1, 2 by four right-closed limits.  ``compat`` scores a missing value +2."""
    score = (F.when(x <= low_bad, -2).when(x <= low_ok, -1).when(x <= high_ok, 0).when(x <= high_bad, 1)
             .when(x.isNotNull(), 2))
    return F.coalesce(score, F.lit(2)) if compat else score


def cut(x: Column, limits: list[float], labels: list, right: bool = True) -> Column:
    """Label of the interval holding x; intervals are right-closed, or left-closed with ``right=False``."""
    out = None
    for lo, hi, label in zip(limits, limits[1:], labels):
        inside = ((x > lo) & (x <= hi)) if right else ((x >= lo) & (x < hi))
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, rational approximation with error below 7.5e-8."""
    # Fixed coefficients of the published approximation (Abramowitz and Stegun 26.2.17).
    p = 0.2316419
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    t = 1 / (1 + p * F.abs(x))
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    tail = F.exp(-x * x / 2) / F.lit(2.5066282746310002) * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)

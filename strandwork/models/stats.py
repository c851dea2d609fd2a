"""Probabilities, intervals and tests as plain functions and as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: the normal quantile used for 95 % intervals throughout
Z95 = 1.96


def normal_p(estimate: float, se: float) -> float:
    """Two-sided p of a normal statistic; NaN unless the error is positive."""
    return math.erfc(abs(estimate / se) / math.sqrt(2)) if se and se > 0 else math.nan


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared with whole degrees of freedom, exact: known for one and two, and two more add one term of a Poisson sum."""
    if x <= 0:
        return 1.0
    half = x / 2
    tail, a = (math.erfc(math.sqrt(half)), 0.5) if df % 2 else (math.exp(-half), 1.0)
    while a < df / 2:
        tail += math.exp(a * math.log(half) - half - math.lgamma(a + 1))
        a += 1
    return min(1.0, tail)


def chi2_tail_cube_root(x: float, df: int) -> float:
    """The cube-root normal approximation of the same tail."""
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of the probabilities of all tables with these margins that are no likelier than the observed one."""
    row, other, column = a + b, c + d, a + c
    log_choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    base = log_choose(row + other, column)
    p = lambda k: math.exp(log_choose(row, k) + log_choose(other, column - k) - base)
    seen = p(a)
    return min(1.0, sum(q for k in range(max(0, column - other), min(row, column) + 1) if (q := p(k)) <= seen + 1e-12))


def two_proportions(e1: int, n1: int, e0: int, n0: int) -> tuple[float, float]:
    """(z, two-sided p) of the difference of two proportions with a pooled error; NaN where it has none."""
    pooled = (e1 + e0) / (n1 + n0) if n1 and n0 else 0.0
    se = math.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0)) if n1 and n0 else 0.0
    return ((e1 / n1 - e0 / n0) / se, normal_p(e1 / n1 - e0 / n0, se)) if se > 0 else (math.nan, math.nan)


def wald(events: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Interval of a proportion by its normal error, within 0 and 1; null where ``n`` is 0."""
    p = F.try_divide(events.cast("double"), n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n))
    return F.greatest(F.lit(0.0), p - half), F.least(F.lit(1.0), p + half)


def wilson(events: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of a proportion, within 0 and 1; null where ``n`` is 0."""
    p = F.try_divide(events.cast("double"), n)
    centre = p + F.try_divide(F.lit(z * z), 2 * n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    scale = 1 + F.try_divide(F.lit(z * z), n)
    return F.greatest(F.lit(0.0), F.try_divide(centre - half, scale)), F.least(F.lit(1.0), F.try_divide(centre + half, scale))


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.10, "*").otherwise("")

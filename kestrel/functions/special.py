"""Distribution tails for test statistics, as Arrow-batched pandas UDFs.

They run on the one aggregated row of a test (never on data rows), so the
Python cost is constant in the data size.  The continued fractions are those
of the Digital Library of Mathematical Functions (8.17.22 for the incomplete
beta function, 8.9.2 for the upper incomplete gamma function), evaluated from
the tail; the lower gamma function is its power series (8.7.1).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _settled(evaluate: Callable[[int], float]) -> float:
    """A continued fraction cut after ever more terms, until it stands still."""
    terms, before = 32, math.nan
    while terms <= 1 << 20:
        now = evaluate(terms)
        if abs(now - before) <= 1e-15 * abs(now):
            return now
        terms, before = 2 * terms, now
    return before


def _beta_fraction(a: float, b: float, x: float) -> float:
    def partial(n: int) -> float:
        """The n-th numerator."""
        m, odd = divmod(n, 2)
        if odd:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))

    def evaluate(terms: int) -> float:
        value = 1.0
        for n in range(terms, 0, -1):
            value = 1.0 + partial(n) / value
        return 1.0 / value
    return _settled(evaluate)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if not 0.0 < x < 1.0:
        return float(x >= 1.0)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x * (a + b + 2.0) < a + 1.0:  # where the fraction converges fast; else by symmetry
        return scale * _beta_fraction(a, b, x) / a
    return 1.0 - scale * _beta_fraction(b, a, 1.0 - x) / b


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = 1
        while term > 1e-17 * total:
            term *= x / (a + k)
            total += term
            k += 1
        return 1.0 - scale * total

    def evaluate(terms: int) -> float:
        value = x
        for n in range(terms, 0, -1):
            value = x + (n - a) / (1.0 + n / value)
        return 1.0 / value
    return scale * _settled(evaluate)


def t_two_sided_p(t: float, df: float) -> float:
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def chi2_sf(stat: float, dof: float) -> float:
    if stat is None or dof is None or math.isnan(stat) or dof <= 0:
        return float("nan")
    return gammaincc(dof / 2.0, stat / 2.0)


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_p(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, b) for a, b in zip(stat, dof)], dtype="float64")

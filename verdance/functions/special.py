"""Tail probabilities. Kernels are NumPy/`math`; on DataFrames they are Arrow UDFs over result rows."""

from __future__ import annotations

from math import exp, lgamma, log, sqrt

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

TINY = 1e-300


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by a continued fraction evaluated from the far end."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tail = 1.0
    for m in range(200, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        tail = 1 + even / (1 + odd / tail)
    first = -(a + b) * x / (a + 1)
    return front / (1 + first / tail)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * exp(-x + a * log(x) - lgamma(a))
    tail = x + 401 - a
    for k in range(200, 0, -1):
        tail = x + 2 * k - 1 - a - k * (k - a) / tail
    return exp(-x + a * log(x) - lgamma(a)) / tail


def f_p(f: float, d1: float, d2: float) -> float | None:
    if f != f or d1 <= 0 or d2 <= 0:
        return None
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_p(t: float, df: float) -> float | None:
    return f_p(t * t, 1, df)


def r_p(r: float, n: float) -> float | None:
    if r != r or n < 3:
        return None
    return 0.0 if abs(r) >= 1 else t_p(r * sqrt((n - 2) / (1 - r * r)), n - 2)


def chi2_p(x: float, df: float) -> float | None:
    return gamma_upper(df / 2, x / 2) if x == x and df > 0 else None


def _series(fn, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*columns, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _series(f_p, f, d1, d2)


@pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return _series(t_p, t, df)


@pandas_udf(DoubleType())
def r_pvalue(r: pd.Series, n: pd.Series) -> pd.Series:
    return _series(r_p, r, n)


@pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series, df: pd.Series) -> pd.Series:
    return _series(chi2_p, x, df)

"""Tail probabilities and exact tests as vectorised column functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _chi2_tail(x: float, k: int) -> float:
    """Upper tail of chi-square for a whole number of degrees of freedom, by the finite sums for even and odd ones."""
    if not x > 0 or k <= 0:
        return 1.0
    half = x / 2
    if k % 2 == 0:
        logs = [i * math.log(half) - math.lgamma(i + 1) - half for i in range(k // 2)]
        return min(1.0, math.fsum(map(math.exp, logs)))
    logs = [(i - 0.5) * math.log(half) - math.lgamma(i + 0.5) - half for i in range(1, (k - 1) // 2 + 1)]
    return min(1.0, math.erfc(math.sqrt(half)) + math.fsum(map(math.exp, logs)))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated from the bottom."""
    value = 0.0
    for m in range(200, 0, -1):
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = even / (1 + odd / (1 + value))
    first = -(a + b) * x / (a + 1)
    return 1 / (1 + first / (1 + value))


def _t_two_sided(t: float, k: float) -> float:
    if t != t or k <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    x, a, b = k / (k + t * t), k / 2, 0.5
    if x >= 1:
        return 1.0
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return min(1.0, scale * _beta_fraction(a, b, x) / a)
    return max(0.0, 1 - scale * _beta_fraction(b, a, 1 - x) / b)


def _fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: all tables with the same margins that are no likelier than the one seen."""
    r0, c0, n = a + b, a + c, a + b + c + d
    low, high = max(0, r0 + c0 - n), min(r0, c0)
    lg = math.lgamma

    def log(i: int) -> float:
        return lg(r0 + 1) - lg(i + 1) - lg(r0 - i + 1) + lg(n - r0 + 1) - lg(c0 - i + 1) - lg(n - r0 - c0 + i + 1) - lg(n + 1) + lg(c0 + 1) + lg(n - c0 + 1)

    x = np.exp([log(i) for i in range(low, high + 1)])
    return float(min(1.0, x[x <= x[a - low] * (1 + 1e-7)].sum()))


def _chi2_column(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or a != a else _chi2_tail(a, int(k)) for a, k in zip(x, dof, strict=True)], dtype="float64")


def _t_column(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([_t_two_sided(a, k) for a, k in zip(t, dof, strict=True)], dtype="float64")


def _fisher_column(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x[0]) else _fisher(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype="float64")


def chi2_sf(x: ColumnOrName, dof: ColumnOrName) -> Column:
    return F.pandas_udf(_chi2_column, "double")(x, dof)


def t_two_sided(t: ColumnOrName, dof: ColumnOrName) -> Column:
    return F.pandas_udf(_t_column, "double")(t, dof)


def fisher_exact(a: ColumnOrName, b: ColumnOrName, c: ColumnOrName, d: ColumnOrName) -> Column:
    """Two-sided p of 2 x 2 tables, row by row."""
    return F.pandas_udf(_fisher_column, "double")(a, b, c, d)

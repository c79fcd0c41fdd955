"""Tail probabilities for rows of test statistics.

The regularised incomplete gamma and beta functions follow the published series and continued
fractions. They run as Arrow batches on executors, on the handful of rows a test produces.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F, types as T

EPS, TINY, STEPS = 1e-15, 1e-300, 5000


def gamma_upper(a: float, x: float) -> float:
    """Upper regularised incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        for k in range(1, STEPS):
            term *= x / (a + k)
            total += term
            if term < total * EPS:
                break
        return 1.0 - total * scale
    b = x + 1 - a
    c, d = 1 / TINY, 1 / b
    h = d
    for k in range(1, STEPS):
        an = -k * (k - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > TINY else TINY)
        c = b + an / c
        c = c if abs(c) > TINY else TINY
        h *= c * d
        if abs(c * d - 1) < EPS:
            break
    return h * scale


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_lower(b, a, 1 - x)
    front = math.exp(
        a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    )
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > TINY else TINY)
    h = d
    for m in range(1, STEPS):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > TINY else TINY)
            c = 1 + num / c
            c = c if abs(c) > TINY else TINY
            h *= c * d
        if abs(c * d - 1) < EPS:
            break
    return front * h / a


def chi2_tail(x: float, dof: float) -> float:
    return gamma_upper(dof / 2, x / 2)


def t_two_sided(t: float, dof: float) -> float:
    return beta_lower(dof / 2, 0.5, dof / (dof + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_lower(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def kolmogorov_tail(x: float) -> float:
    """Limit distribution of the scaled Kolmogorov-Smirnov distance."""
    if x <= 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def k2(n: float, g1: float, g2: float) -> float | None:
    """D'Agostino-Pearson K^2 from population skewness and excess kurtosis, from 8 values on.

    Skewness score after D'Agostino (1970), kurtosis score after Anscombe and Glynn (1983).
    """
    if n < 8:
        return None
    y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta - 1)) - 1
    z_skew = math.asinh(y * math.sqrt((w2 - 1) / 2)) / math.sqrt(math.log(w2) / 2)
    spread = math.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)))
    x = (g2 + 3 - 3 * (n - 1) / (n + 1)) / spread
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + math.sqrt(1 + 4 / root**2))
    bottom = 1 + x * math.sqrt(2 / (a - 4))
    cube = math.copysign((abs((1 - 2 / a) / bottom)) ** (1 / 3), bottom)
    z_kurt = (1 - 2 / (9 * a) - cube) / math.sqrt(2 / (9 * a))
    return z_skew**2 + z_kurt**2


def _rows(fn, *columns: pd.Series) -> pd.Series:
    return pd.Series(
        [None if any(v is None or v != v for v in r) else fn(*r) for r in zip(*columns)], dtype="float64"
    )


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _rows(chi2_tail, x, dof)


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _rows(t_two_sided, t, dof)


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _rows(f_tail, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def k2_statistic(n: pd.Series, g1: pd.Series, g2: pd.Series) -> pd.Series:
    return _rows(k2, n, g1, g2)


@F.pandas_udf(T.DoubleType())
def kolmogorov_p(x: pd.Series) -> pd.Series:
    return _rows(kolmogorov_tail, x)

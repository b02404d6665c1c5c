"""Special functions for p-values, in NumPy inside Arrow UDFs."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType



def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    value = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + term / c
            c = c if abs(c) > 1e-300 else 1e-300
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def gammaincc(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = value = 1 / b
    for i in range(1, 1000):
        step, b = -i * (i - a), b + 2
        d = 1 / (step * d + b)
        c = b + step / c
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_sf2(t: float, df: float) -> float:
    """Two-sided P(|T| > |t|)."""
    return betainc(df / 2, 0.5, df / (df + t * t))


def chi2_sf(q: float, df: float) -> float:
    """P(chi-squared > q)."""
    return gammaincc(df / 2, q / 2)


def norm_ppf(p: np.ndarray) -> np.ndarray:
    """Inverse of the normal distribution, by bisection-free Newton steps from a logistic start."""
    p = np.clip(np.asarray(p, float), 1e-7, 1 - 1e-7)
    x = np.log(p / (1 - p)) / 1.702
    erf = np.vectorize(math.erf, otypes=[float])
    for _ in range(60):
        gap = (0.5 * (1 + erf(x / math.sqrt(2))) - p) / (np.exp(-(x**2) / 2) / math.sqrt(2 * math.pi))
        x = x - np.clip(gap, -0.5, 0.5)
        if np.abs(gap).max(initial=0) < 1e-12:
            break
    return x


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """P(studentised range of k means > q), by two nested quadratures."""
    if q <= 0:
        return 1.0
    z, wz = np.polynomial.legendre.leggauss(96)
    z, wz = z * 8, wz * 8
    phi = np.exp(-(z**2) / 2) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), otypes=[float])
    spread = 1 + 8 / math.sqrt(2 * max(df, 1)) if df < 1e5 else 1.0
    s, ws = np.polynomial.legendre.leggauss(64)
    top = max(spread, 1.5)
    s, ws = (s + 1) * top / 2, ws * top / 2
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s**2 / 2
    inner = np.array([k * np.sum(wz * phi * (cdf(z) - cdf(z - q * v)) ** (k - 1)) for v in s])
    return float(min(1.0, max(0.0, 1 - np.sum(ws * np.exp(log_density) * inner))))


@lru_cache(maxsize=1024)
def studentized_range_ppf(alpha: float, k: int, df: float) -> float:
    """The range that k means exceed with probability alpha, by bisection."""
    low, high = 0.0, 4.0
    while studentized_range_sf(high, k, df) > alpha and high < 1e4:
        high *= 2
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if studentized_range_sf(middle, k, df) > alpha else (low, middle)
        if high - low < 1e-9 * high:
            break
    return (low + high) / 2


def _column(f, *cols: Column) -> Column:
    @F.pandas_udf(DoubleType())
    def run(*xs: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*xs, strict=True)], dtype="float64")

    return run(*(c.cast("double") for c in cols))


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    return _column(f_sf, f, d1, d2)


def t_p(t: Column, df: Column) -> Column:
    return _column(t_sf2, t, df)


def chi2_p(q: Column, df: Column) -> Column:
    return _column(chi2_sf, q, df)


def range_p(q: Column, k: Column, df: Column) -> Column:
    return _column(lambda a, b, c: studentized_range_sf(a, int(b), c), q, k, df)


def range_quantile(alpha: Column, k: Column, df: Column) -> Column:
    return _column(lambda a, b, c: studentized_range_ppf(a, int(b), c) , alpha, k, df)


def probit(p: Column) -> Column:
    @F.pandas_udf(DoubleType())
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(np.where(values.isna(), np.nan, norm_ppf(values.fillna(0.5).to_numpy(float)))).where(~values.isna().to_numpy(), None)

    return run(p)

"""Tail probabilities as column functions (Arrow batches of numbers; no table is held)."""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    b, c = x + 1.0 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t)) if df > 0 else math.nan


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)) if d1 > 0 and d2 > 0 and f >= 0 else math.nan


def chi2_upper(x: float, df: float) -> float:
    return gamma_q(df / 2.0, x / 2.0) if df > 0 else math.nan


def ks_upper(d: float, n1: float, n2: float) -> float:
    """Asymptotic two-sample Kolmogorov-Smirnov tail."""
    lam = d * math.sqrt(n1 * n2 / (n1 + n2))
    if lam < 1e-3:
        return 1.0
    s = sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * lam * lam) for k in range(1, 101))
    return min(max(2.0 * s, 0.0), 1.0)


@functools.lru_cache(maxsize=65536)
def t_quantile(p: float, df: float) -> float:
    """P(T <= t) = p for p > 0.5: Newton steps from a normal quantile with the first correction for the degrees."""
    z = NormalDist().inv_cdf(p)
    t = z + (z**3 + z) / (4.0 * df)
    log_norm = math.lgamma((df + 1) / 2.0) - math.lgamma(df / 2.0) - 0.5 * math.log(df * math.pi)
    for _ in range(50):
        density = math.exp(log_norm - (df + 1) / 2.0 * math.log1p(t * t / df))
        step = (1.0 - t_two_sided(t, df) / 2.0 - p) / density
        step = max(min(step, t / 2.0), -2.0 * t)  # small degrees: stay positive and do not overshoot
        t -= step
        if abs(step) < 1e-12 * max(t, 1.0):
            break
    return t


def _each(fn, *cols: pd.Series) -> pd.Series:
    out = []
    for args in zip(*[c.to_numpy(dtype=float) for c in cols]):
        out.append(None if any(np.isnan(a) for a in args) else fn(*args))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def norm_two_sided_p(z: pd.Series) -> pd.Series:
    return _each(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), z)


@F.pandas_udf(T.DoubleType())
def norm_cdf_col(z: pd.Series) -> pd.Series:
    return _each(norm_cdf, z)


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _each(f_upper, f, d1, d2)


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return _each(chi2_upper, x, df)


@F.pandas_udf(T.DoubleType())
def ks_p(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return _each(ks_upper, d, n1, n2)


@F.pandas_udf(T.DoubleType())
def t_quantile_col(p: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_quantile, p, df)


@F.pandas_udf(T.DoubleType())
def lgamma_col(x: pd.Series) -> pd.Series:
    return _each(math.lgamma, x)

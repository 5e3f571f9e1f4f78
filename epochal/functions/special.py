"""Special functions that Spark lacks: numpy over Arrow batches, and the numpy forms that likelihoods use."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Coefficients of Stirling's series: 1/12, -1/360, 1/1260, -1/1680, 1/1188, -691/360360, 1/156
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)


def np_log_gamma(x) -> np.ndarray:
    """Stirling's series from 8 on, and the recurrence below; nan where x isn't positive."""
    x = np.asarray(x, float)
    with np.errstate(all="ignore"):
        y, down = np.where(x > 0, x, np.nan), np.zeros(x.shape)
        for _ in range(8):
            low = y < 8
            down = down + np.where(low, np.log(y), 0.0)
            y = y + low
        series = sum(c / y ** (2 * k + 1) for k, c in enumerate(_STIRLING))
        return np.where(np.isinf(x) & (x > 0), np.inf, (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - down)


def np_normal(x) -> np.ndarray:
    """The normal distribution function."""
    x = np.asarray(x, float)
    lower, upper = _gamma_sides(np.full(x.shape, 0.5), x * x / 2)
    return np.where(x < 0, upper / 2, 0.5 + lower / 2)


def np_incomplete_gamma(a, x) -> np.ndarray:
    """The regularised lower incomplete gamma function."""
    return _gamma_sides(*np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float)))[0]


def _gamma_sides(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower and the upper function: the series of the first below a + 1, the continued fraction of the second above."""
    lower, upper = np.full(a.shape, np.nan), np.full(a.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    low, high = ok & (x < a + 1), ok & (x >= a + 1)
    with np.errstate(all="ignore"):
        if low.any():
            b, y = a[low], x[low]
            term = total = 1 / b
            for k in range(1, 2000):
                term = term * y / (b + k)
                total = total + term
                if np.all(term <= total * 1e-16):
                    break
            lower[low] = np.where(y > 0, total * np.exp(-y + b * np.log(y) - np_log_gamma(b)), 0.0)
            upper[low] = 1 - lower[low]
        if high.any():
            b, y = a[high], x[high]
            c, d = np.full(b.shape, 1e300), 1 / (y + 1 - b)
            h = d.copy()
            for k in range(1, 2000):
                an, bn = -k * (k - b), y + 2 * k + 1 - b
                d = 1 / np.where(np.abs(an * d + bn) < 1e-300, 1e-300, an * d + bn)
                c = np.where(np.abs(bn + an / c) < 1e-300, 1e-300, bn + an / c)
                h = h * c * d
                if np.all(np.abs(c * d - 1) < 1e-15):
                    break
            upper[high] = np.where(np.isinf(y), 0.0, h * np.exp(-y + b * np.log(y) - np_log_gamma(b)))
            lower[high] = 1 - upper[high]
    return lower, upper


def np_incomplete_beta(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction on the side where it converges."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(np_log_gamma(a + b) - np_log_gamma(a) - np_log_gamma(b) + p * np.log(y) + q * np.log1p(-y)) / p
        tiny = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
        c, d = np.ones(p.shape), 1 / tiny(1 - (p + q) * y / (p + 1))
        h = d.copy()
        for k in range(1, 500):
            for step in (k * (q - k) * y / ((p + 2 * k - 1) * (p + 2 * k)), -(p + k) * (p + q + k) * y / ((p + 2 * k) * (p + 2 * k + 1))):
                d, c = 1 / tiny(1 + step * d), tiny(1 + step / c)
                h = h * c * d
            if np.all(np.abs(c * d - 1) < 1e-15):
                break
        out = np.where(y <= 0, 0.0, front * h)
    out = np.where(flip, 1 - out, out)
    return np.where((a > 0) & (b > 0) & (x >= 0) & (x <= 1), out, np.nan)


def np_beta_quantile(p, a, b) -> np.ndarray:
    """Where the regularised incomplete beta function reaches p, by halving."""
    p, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (p, a, b)))
    low, high = np.zeros(p.shape), np.ones(p.shape)
    for _ in range(60):
        mid = (low + high) / 2
        less = np_incomplete_beta(a, b, mid) < p
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return np.where((a > 0) & (b > 0), (low + high) / 2, np.nan)


def np_normal_quantile(p) -> np.ndarray:
    """By halving, to the last bit: 60 steps over [-40, 40]."""
    p = np.asarray(p, float)
    low, high = np.full(p.shape, -40.0), np.full(p.shape, 40.0)
    for _ in range(64):
        mid = (low + high) / 2
        less = np_normal(mid) < p
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    out = (low + high) / 2
    return np.where((p > 0) & (p < 1), out, np.where(p == 0, -np.inf, np.where(p == 1, np.inf, np.nan)))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(48)


def np_bivariate_normal(x, y, r) -> np.ndarray:
    """P(X <= x, Y <= y) with correlation r: the integral of the density over correlations up to r."""
    x, y, r = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, y, r)))
    top = np.arcsin(np.clip(r, -1, 1))
    t = top[..., None] * (_NODES + 1) / 2
    s, c2 = np.sin(t), np.maximum(np.cos(t) ** 2, 1e-300)
    inside = np.exp(-(x[..., None] ** 2 + y[..., None] ** 2 - 2 * x[..., None] * y[..., None] * s) / (2 * c2))
    return np_normal(x) * np_normal(y) + top / 2 * (inside * _WEIGHTS).sum(-1) / (2 * math.pi)


def np_chi2(x, df) -> np.ndarray:
    return np_incomplete_gamma(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def np_student(t, df) -> np.ndarray:
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    tail = np_incomplete_beta(df / 2, np.full(df.shape, 0.5), df / (df + t * t)) / 2
    return np.where(t > 0, 1 - tail, tail)


def np_fisher(x, d1, d2) -> np.ndarray:
    x, d1, d2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, d1, d2)))
    x = np.maximum(x, 0)
    return np_incomplete_beta(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2))


def _one(f):
    @F.pandas_udf(DoubleType())
    def udf(x: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(float)))

    return udf


def _two(f):
    @F.pandas_udf(DoubleType())
    def udf(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(float), y.to_numpy(float)))

    return udf


def _three(f):
    @F.pandas_udf(DoubleType())
    def udf(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy(float), y.to_numpy(float), z.to_numpy(float)))

    return udf


normal = _one(np_normal)
normal_quantile = _one(np_normal_quantile)
#: Density over what is above: the hazard of the normal distribution.
normal_hazard = _one(lambda x: np.exp(-x * x / 2) / math.sqrt(2 * math.pi) / np_normal(-x))
incomplete_gamma = _two(np_incomplete_gamma)
chi2 = _two(np_chi2)
student = _two(np_student)
incomplete_beta = _three(np_incomplete_beta)
fisher = _three(np_fisher)
beta_quantile = _three(np_beta_quantile)
bivariate_normal = _three(np_bivariate_normal)

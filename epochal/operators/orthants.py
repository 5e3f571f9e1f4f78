"""Probit models of several dimensions, by recursive conditioning of the normal distribution over fixed points.

The probability that normal variables are all below their bounds is a mean over points of the unit cube of products of one-dimensional
probabilities. Points are the nodes of Gauss and Legendre's rule up to three dimensions, and beyond that a lattice, moved for each row by a
hash of it: likelihoods at different parameters are comparable, and errors of rows don't add up. Alike rows are added up first.
"""

from __future__ import annotations

import functools
import itertools
import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.special import np_normal
from ..plans.fitting import Fit, maximise, summed
from ..plans.iterate import discard, settled

#: Nodes in each of one or two dimensions, and points of the lattice in more.
NODES, POINTS = (48, 20), 512
#: Rows that are worked on at a time.
ROWS = 1000


@functools.cache
def _table() -> tuple[np.ndarray, np.ndarray]:
    """The distribution function at equal steps."""
    x = np.linspace(-9, 9, 2**14 + 1)
    return x, np_normal(x)


def _density(x: np.ndarray) -> np.ndarray:
    return np.exp(-x * x / 2) / np.sqrt(2 * np.pi)


def _normal(x: np.ndarray) -> np.ndarray:
    """The distribution function by cubics through its values and slopes at the table's steps: exact to 1e-14."""
    grid, value = _table()
    h = grid[1] - grid[0]
    x = np.clip(x, -8.99, 8.99)
    k = ((x - grid[0]) / h).astype(np.int64)
    t, a, b = (x - grid[k]) / h, grid[k], grid[k] + h
    s = 1 - t
    return value[k] * (1 + 2 * t) * s * s + value[k + 1] * t * t * (1 + 2 * s) + h * (_density(a) * t * s * s - _density(b) * t * t * s)


def _quantile(p: np.ndarray) -> np.ndarray:
    """Where _normal reaches p: between the table's steps, then a Newton step."""
    grid, value = _table()
    x = np.interp(p, value, grid)
    return x - np.clip((_normal(x) - p) / np.maximum(_density(x), 1e-18), -0.01, 0.01)


def _points(dimensions: int, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (rows or 1, points, dimensions) and weights (points)."""
    if dimensions == 0:
        return np.zeros((1, 1, 0)), np.ones(1)
    if dimensions <= 2:
        x, w = np.polynomial.legendre.leggauss(NODES[dimensions - 1])
        x, w = (x + 1) / 2, w / 2
        grid = np.array(list(itertools.product(x, repeat=dimensions)))
        return grid[None], np.prod(np.array(list(itertools.product(w, repeat=dimensions))), axis=1)
    primes = [k for k in range(2, 60) if all(k % j for j in range(2, k))][:dimensions]
    steps = np.sqrt(np.array(primes, float)) % 1
    own = (shift[:, None] * (1 + np.arange(dimensions)) ** 2 * 0.7548776662466927) % 1
    at = (np.arange(1, POINTS + 1)[None, :, None] * steps + own[:, None, :]) % 1
    return 1 - np.abs(2 * at - 1), np.full(POINTS, 1 / POINTS)


def np_orthant(bounds: np.ndarray, covariance: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The probability that variables of mean 0 and that covariance are all below bounds (rows by variables); nan if it isn't positive definite."""
    n, m = bounds.shape
    try:
        low = np.linalg.cholesky(covariance)
    except np.linalg.LinAlgError:
        return np.full(n, np.nan)
    out = np.empty(n)
    for begin in range(0, n, ROWS):
        part = slice(begin, begin + ROWS)
        b, (u, w) = bounds[part], _points(m - 1, shift[part])
        seen, total = [], np.ones((len(b), len(w)))
        for j in range(m):
            above = b[:, j, None] - sum((low[j, k] * seen[k] for k in range(j)), np.zeros((1, 1)))
            p = _normal(np.broadcast_to(above / low[j, j], total.shape))
            total = total * p
            if j < m - 1:
                seen.append(_quantile(np.clip(u[:, :, j] * p, 1e-300, 1 - 1e-16)))
        out[part] = total @ w
    return out


def multivariate_normal(bounds: Sequence[Column | str], correlations: np.ndarray) -> Column:
    """The distribution function of normal variables of mean 0 at columns; null where one is null. Exact to 6 digits for two variables, 4 for three and 3 beyond, where no correlation is close to 1."""
    r, cells = np.atleast_2d(np.asarray(correlations, float)), [F.col(c) if isinstance(c, str) else c for c in bounds]

    @F.pandas_udf(DoubleType())
    def udf(x: pd.Series, u: pd.Series) -> pd.Series:
        a = np.vstack(x.to_list()) if len(x) else np.zeros((0, len(r)))
        return pd.Series(np_orthant(a.astype(float), r, u.to_numpy(float)))

    one = F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in cells])
    known = cells[0].isNotNull()
    for c in cells[1:]:
        known = known & c.isNotNull()
    return F.when(known, udf(one, _share(cells)))


def _share(cells: Sequence[Column]) -> Column:
    """A number from 0 to 1 by a hash of a row's values."""
    return F.pmod(F.xxhash64(*cells), F.lit(2**31)) / 2**31


def _alike(df: DataFrame, names: Sequence[str], weight: str | None) -> DataFrame:
    names = list(dict.fromkeys(names))
    cells = df.dropna(subset=names).select(*[F.col(c).cast("double").alias(c) for c in names], (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("_w"))
    return cells.groupBy(*names).agg(F.sum("_w").alias("_w")).withColumn("_u", _share([F.col(c) for c in names]))


def _fitted(rows: DataFrame, loglik, names: Sequence[str], last: int) -> Fit:
    """loglik(batch, parameters): of each row. The last parameters are held at 0 first, as scores can't tell them from constants at the start. First steps are by
    outer products of scores, which are cheap and always upwards; the last ones, and errors, by second differences."""
    p, kept = len(names), settled(rows)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def scores(f: pd.DataFrame, b: np.ndarray) -> np.ndarray:
        return np.column_stack([(loglik(f, b + 1e-5 * e) - loglik(f, b - 1e-5 * e)) / 2e-5 for e in np.eye(p)])

    def sums(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def batch(f: pd.DataFrame) -> np.ndarray:
            w, score = f["_w"].to_numpy(float), scores(f, b)
            return np.concatenate([[w @ loglik(f, b)], w @ score, ((score.T * w) @ score).ravel()])

        s = summed(kept, 1 + p + p * p, batch)
        return float(s[0]), s[1 : 1 + p], s[1 + p :].reshape(p, p)

    def without(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        value, grad, info = sums(np.concatenate([b, np.zeros(last)]))
        return value, grad[: p - last], info[: p - last, : p - last]

    def bent(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def batch(f: pd.DataFrame) -> np.ndarray:
            w, h = f["_w"].to_numpy(float), 1e-3
            e = np.eye(p) * h
            at = lambda i, j, x, y: w @ loglik(f, b + x * e[i] + y * e[j])
            second = [(at(i, j, 1, 1) - at(i, j, 1, -1) - at(i, j, -1, 1) + at(i, j, -1, -1)) / (4 * h * h) for i, j in pairs]
            return np.concatenate([[w @ loglik(f, b)], w @ scores(f, b), second])

        s = summed(kept, 1 + p + len(pairs), batch)
        info = np.zeros((p, p))
        for (i, j), v in zip(pairs, s[1 + p :]):
            info[i, j] = info[j, i] = -v
        return float(s[0]), s[1 : 1 + p], info

    with np.errstate(all="ignore"):
        with warnings.catch_warnings():  # whether they have settled is for the last steps to say
            warnings.simplefilter("ignore", RuntimeWarning)
            start = [*maximise(without, np.zeros(p - last), names[: p - last], steps=12).coef, *([0.0] * last)]
            if last:
                start = maximise(sums, start, names, steps=12).coef
        fit = maximise(bent, start, names, steps=30)
    discard(kept)
    return fit


def _correlations(m: int, free: Sequence[tuple[int, int]]):
    """The matrix of m variables from parameters x: correlation tanh(x / 2) for each pair of free, 0 for the others."""

    def of(x: np.ndarray) -> np.ndarray:
        r = np.eye(m)
        for (i, j), v in zip(free, x):
            r[i, j] = r[j, i] = np.tanh(v / 2)
        return r

    return of


def _told(fit: Fit, free: int) -> Fit:
    """The last free parameters as correlations."""
    if free:
        r = np.tanh(fit.coef[-free:] / 2)
        scale = np.ones(len(fit.coef))
        scale[-free:] = (1 - r * r) / 2
        fit.coef[-free:] = r
        fit.covariance = fit.covariance * np.outer(scale, scale)
    return fit


def simultaneous_probit(df: DataFrame, equations: Sequence[tuple[str, Sequence[str]]], correlated: Sequence[tuple[int, int]] | None = None, weight: str | None = None) -> Fit:
    """Binary outcomes (0 or 1), each 1 where constant + x coef plus a normal error is positive; the errors are correlated.

    equations: an outcome and its columns each. correlated: pairs of equations (from 0) whose correlation is estimated; none given: all pairs.
    """
    m = len(equations)
    free = [tuple(sorted(c)) for c in correlated] if correlated is not None else list(itertools.combinations(range(m), 2))
    of, widths = _correlations(m, free), [1 + len(c) for _, c in equations]
    ends = np.cumsum(widths)

    def loglik(f: pd.DataFrame, b: np.ndarray) -> np.ndarray:
        signs = np.column_stack([2 * f[y].to_numpy(float) - 1 for y, _ in equations])
        lines = np.column_stack([np.column_stack([np.ones(len(f)), *(f[c].to_numpy(float) for c in cols)]) @ b[e - k : e] for (_, cols), k, e in zip(equations, widths, ends)])
        r, u, out = of(b[ends[-1] :]), f["_u"].to_numpy(float), np.empty(len(f))
        kinds, at = np.unique(signs, axis=0, return_inverse=True)
        for k, s in enumerate(kinds):  # rows of the same outcomes have one covariance
            mine = at.ravel() == k
            out[mine] = np_orthant((signs * lines)[mine], r * np.outer(s, s), u[mine])
        return np.log(np.clip(out, 1e-300, None))

    names = [f"{y}:{n}" for y, c in equations for n in ["constant", *c]] + [f"correlation_{i}_{j}" for i, j in free]
    rows = _alike(df, [n for y, c in equations for n in [y, *c]], weight)
    return _told(_fitted(rows, loglik, names, len(free)), len(free))


def multinomial_probit(df: DataFrame, y: str, columns: Sequence[str], categories: Sequence[int], correlated: Sequence[tuple[int, int]] = (), alternatives: dict[str, Sequence[str]] | None = None, constant: bool = True, weight: str | None = None) -> Fit:
    """The category of the largest utility: constant + x coef of its own (0 for the first category) plus coefficients of alternatives, plus a normal error of variance 1.

    alternatives: a name for each variable that differs by category, with its columns in the order of categories. correlated: pairs of
    categories (places from 0) whose errors' correlation is estimated; the others are 0.
    """
    q, more = len(categories), alternatives or {}
    free, own = [tuple(sorted(c)) for c in correlated], ([1] if constant else []) + list(columns)
    of, width = _correlations(q, free), len(own)

    def loglik(f: pd.DataFrame, b: np.ndarray) -> np.ndarray:
        x = np.column_stack([*([np.ones(len(f))] if constant else []), *(f[c].to_numpy(float) for c in columns), np.zeros((len(f), 0))])
        use = np.column_stack([np.zeros(len(f)), *(x @ b[k * width : (k + 1) * width] for k in range(q - 1))])
        for k, cols in enumerate(more.values()):
            use = use + b[(q - 1) * width + k] * np.column_stack([f[c].to_numpy(float) for c in cols])
        r, u, out = of(b[(q - 1) * width + len(more) :]), f["_u"].to_numpy(float), np.empty(len(f))
        value = f[y].to_numpy(float)
        for k, c in enumerate(categories):
            mine = value == c
            if mine.any():
                turn = np.delete(np.eye(q), k, axis=0)
                turn[:, k] = -1.0  # errors of the others less that of this one
                out[mine] = np_orthant(use[mine] @ -turn.T, turn @ r @ turn.T, u[mine])
        return np.log(np.clip(out, 1e-300, None))

    names = [f"{c}:{n}" for c in list(categories)[1:] for n in [*(["constant"] if constant else []), *columns]] + list(more) + [f"correlation_{i}_{j}" for i, j in free]
    rows = _alike(df.where(F.col(y).isin([float(c) for c in categories])), [y, *columns, *[c for v in more.values() for c in v]], weight)
    return _told(_fitted(rows, loglik, names, len(free)), len(free))

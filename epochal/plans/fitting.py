"""Likelihoods maximised by sums over rows: each step is one aggregate of value, gradient and information.

The rows stay distributed; the driver sees sums as many as the square of the parameters.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Fit:
    """names, coef and covariance of the estimates, the log-likelihood at them, the steps taken, and whether they have settled."""

    names: list[str]
    coef: np.ndarray
    covariance: np.ndarray
    loglik: float
    steps: int
    converged: bool = True

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.covariance), 0, None))

    def table(self, spark) -> DataFrame:
        rows = [(n, float(b), float(s), float(b / s) if s > 0 else None) for n, b, s in zip(self.names, self.coef, self.se)]
        return spark.createDataFrame(rows, "term string, coef double, se double, ratio double")


def maximise(sums: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], start: Sequence[float], names: Sequence[str], steps: int = 50, tol: float = 1e-9) -> Fit:
    """Newton steps, halved while the value falls. sums(b): value, gradient, information (minus the second derivatives).

    Steps that have not settled, at the last one or where no part of one raises the value, are told by converged and a warning.
    """
    b, settled = np.asarray(start, float), False
    value, grad, info = sums(b)
    k = 0
    for k in range(1, steps + 1):
        ridge, eye = 0.0, np.eye(len(b))
        while True:  # away from the top the information may be indefinite
            try:
                np.linalg.cholesky(info + ridge * eye)
                break
            except np.linalg.LinAlgError:
                ridge = max(2 * ridge, 1e-6 * max(1.0, np.abs(info).max()))
                if ridge > 1e12:
                    raise
        move = np.linalg.solve(info + ridge * eye, grad)
        scale = 1.0
        for _ in range(30):
            trial = sums(b + scale * move)
            if all(np.isfinite(x).all() for x in trial) and trial[0] >= value - 1e-9 * (1 + abs(value)):
                break
            scale /= 2
        else:
            settled = abs(grad @ move) <= 1e-6 * (1 + abs(value))  # nothing more to gain
            break
        b, gain = b + scale * move, trial[0] - value
        value, grad, info = trial
        if abs(gain) <= tol * (1 + abs(value)) and np.abs(scale * move).max() <= 1e-6 * (1 + np.abs(b).max()):
            settled = True
            break
    if not settled:
        warnings.warn(f"the estimates have not settled after {k} steps", RuntimeWarning, stacklevel=2)
    return Fit(list(names), b, np.linalg.pinv(info), float(value), k, settled)


def gram(df: DataFrame, columns: Sequence[Column], weight: Column | None = None) -> np.ndarray:
    """The matrix of sums of products of columns (times weight) in one aggregate of built-in functions."""
    w = F.lit(1.0) if weight is None else weight
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = df.agg(*[F.sum(w * columns[i] * columns[j]).alias(f"s{k}") for k, (i, j) in enumerate(pairs)]).first()
    out = np.zeros((p, p))
    for k, (i, j) in enumerate(pairs):
        out[i, j] = out[j, i] = row[k] or 0.0
    return out


def summed(df: DataFrame, size: int, batch: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """The sum over all Arrow batches of a vector of fixed size; partitions add up their own first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(size), False
        for f in frames:
            if len(f):
                total, seen = total + batch(f), True
        if seen:
            yield pd.DataFrame({"k": np.arange(size), "v": total})

    rows = df.mapInPandas(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r.k] = r.v
    return out


def by_predictors(df: DataFrame, designs: Sequence[Sequence[str]], loglik: Callable[..., np.ndarray], data: Sequence[str], weight: str | None = None) -> Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]:
    """sums() for a log-likelihood of each row in linear predictors: loglik(*predictors, *data columns).

    designs: for each predictor its columns; a constant comes first in each. First derivatives in the
    predictors are taken by complex steps where loglik allows, second ones by differences of them.
    """
    used = list(dict.fromkeys([c for d in designs for c in d] + list(data) + ([weight] if weight else [])))
    df = df.select(*[F.col(c).cast("double").alias(c) for c in used])
    widths = [1 + len(d) for d in designs]
    ends = np.cumsum(widths)
    p, m = int(ends[-1]), len(designs)

    def sums(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        parts = np.split(b, ends[:-1])

        def batch(f: pd.DataFrame) -> np.ndarray:
            xs = [np.column_stack([np.ones(len(f)), *(f[c].to_numpy() for c in d)]) for d in designs]
            more = [f[c].to_numpy() for c in data]
            w = f[weight].to_numpy() if weight else np.ones(len(f))
            etas = [x @ q for x, q in zip(xs, parts)]

            def slopes(at: list[np.ndarray]) -> list[np.ndarray]:
                out = []
                for k in range(m):
                    moved = [a.astype(complex) for a in at]
                    moved[k] = moved[k] + 1e-20j
                    out.append(loglik(*moved, *more).imag / 1e-20)
                return out

            value, g = loglik(*etas, *more), slopes(etas)
            grad = np.concatenate([x.T @ (w * s) for x, s in zip(xs, g)])
            info = np.zeros((p, p))
            starts = ends - widths
            for k in range(m):
                h = 1e-5
                up, down = slopes([e + h * (j == k) for j, e in enumerate(etas)]), slopes([e - h * (j == k) for j, e in enumerate(etas)])
                for j in range(m):
                    second = (up[j] - down[j]) / (2 * h)
                    info[starts[k] : ends[k], starts[j] : ends[j]] = -(xs[k].T * (w * second)) @ xs[j]
            return np.concatenate([[np.sum(w * value)], grad, ((info + info.T) / 2).ravel()])

        s = summed(df, 1 + p + p * p, batch)
        return float(s[0]), s[1 : 1 + p], s[1 + p :].reshape(p, p)

    return sums

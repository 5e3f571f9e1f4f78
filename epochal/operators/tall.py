"""Least squares and singular values of tall matrices by a tree of QR factors.

Each partition reduces its rows to a triangle batch by batch, and triangles are stacked and reduced again, FAN at a time, until one
is left: as many numbers as columns squared reach the driver. Products of columns are never formed, so that the condition isn't squared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fitting import Fit
from ..plans.iterate import discard, settled

#: Triangles that one task puts together.
FAN = 32


def _reduced(rows: np.ndarray) -> np.ndarray:
    """The triangle of rows, with zeros below where rows are fewer than columns; its diagonal isn't negative."""
    p = rows.shape[1]
    r = np.zeros((p, p))
    q = np.linalg.qr(rows, mode="r")
    r[: len(q)] = q
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def triangle(df: DataFrame, columns: Sequence[Column | str], weight: str | None = None) -> np.ndarray:
    """R of the QR factors of the matrix whose columns are given; rows with a null are left out, weights are of their squares. No rows: zeros."""
    p = len(columns)
    cells = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns]
    scale = F.lit(1.0) if weight is None else F.sqrt(F.col(weight).cast("double"))
    x = df.select(*[(c * scale).alias(f"_{k}") for k, c in enumerate(cells)]).dropna()

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = None
        for f in frames:
            a = f.to_numpy(float)
            if len(a):
                r = _reduced(a if r is None else np.vstack([r, a]))
        if r is not None:
            yield pd.DataFrame({"r": [r.ravel()]})

    def joined(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [f["at"].iloc[0] // FAN], "r": [_reduced(np.vstack([r.reshape(p, p) for r in f.sort_values("at")["r"]])).ravel()]})

    now = settled(x.mapInPandas(parts, "r array<double>").select(F.spark_partition_id().cast("long").alias("at"), "r"))
    while (last := now.agg(F.max("at")).first()[0]) is not None and last > 0:
        now = settled(now.groupBy(F.floor(F.col("at") / FAN)).applyInPandas(joined, "at long, r array<double>"), now)
    row = now.first()
    discard(now)
    return np.zeros((p, p)) if row is None else np.array(row.r).reshape(p, p)


def singular_values(df: DataFrame, columns: Sequence[Column | str]) -> tuple[np.ndarray, np.ndarray]:
    """The singular values, largest first, and the right vectors, a column for each, whose largest entry is positive."""
    _, s, v = np.linalg.svd(triangle(df, columns))
    v = v.T
    signs = np.sign(v[np.abs(v).argmax(0), np.arange(len(s))])
    return s, v * np.where(signs == 0, 1.0, signs)


def left_vectors(df: DataFrame, columns: Sequence[str], name: str = "u", eps: float = 1e-12) -> DataFrame:
    """df with an entry of each left vector: columns name1, name2, ..., of the singular values that aren't 0."""
    s, v = singular_values(df, columns)
    kept = [k for k in range(len(s)) if s[k] > eps * max(s[0], 1e-300)]
    value = lambda k: sum((F.col(c).cast("double") * float(v[j, k] / s[k]) for j, c in enumerate(columns)), F.lit(0.0))
    return df.withColumns({f"{name}{k + 1}": value(k) for k in kept})


def least_squares(df: DataFrame, y: str, columns: Sequence[str], weight: str | None = None, constant: bool = True, eps: float = 1e-13) -> Fit:
    """Linear regression from one triangle of the predictors and y. Directions whose singular value is below eps of the largest (of columns of length 1)
    have no part: the shortest coefficients are given then. loglik is minus the residual sum of squares."""
    df = df.dropna(subset=[y, *columns])
    names = (["constant"] if constant else []) + list(columns)
    r = triangle(df, [*([F.lit(1.0)] if constant else []), *columns, y], weight)
    p, n = len(names), df.count()
    length = np.linalg.norm(r[:, :p], axis=0)
    length[length == 0] = 1.0
    u, s, v = np.linalg.svd(r[:p, :p] / length)
    use = s > eps * max(s.max(initial=0), 1e-300)
    turn = (v.T[:, use] / s[use]) / length[:, None]
    rss = float(r[p, p] ** 2)
    return Fit(names, turn @ (u[:, use].T @ r[:p, p]), turn @ turn.T * rss / max(1, n - int(use.sum())), -rss, 1)

"""Correspondence analysis of tables of counts with any number of rows and columns.

The table stays as cells (i, j, n). A few vectors at a time are multiplied by the standardised table and back, each a join and a grouped sum,
and made orthogonal by the matrix of their products, which alone reaches the driver, until their lengths settle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fitting import summed
from ..plans.iterate import discard, settled

#: Vectors beyond those asked for: the more, the fewer rounds.
SPARE = 3


def _turned(df: DataFrame, key: str, names: list[str], by: np.ndarray) -> DataFrame:
    """The vectors names times a small matrix."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            new = pd.DataFrame(f[names].to_numpy(float) @ by, columns=names, index=f.index)
            yield pd.concat([f[[key, "mass"]], new], axis=1)

    df = df.select(key, "mass", *names)
    return df.mapInPandas(run, df.schema)


def _products(df: DataFrame, names: list[str]) -> np.ndarray:
    """The matrix of products of the vectors names."""

    def batch(f: pd.DataFrame) -> np.ndarray:
        x = f.to_numpy(float)
        return (x.T @ x).ravel()

    return summed(df.select(*names), len(names) ** 2, batch).reshape(len(names), len(names))


def correspondence(cells: DataFrame, dimensions: int = 2, rounds: int = 300, eps: float = 1e-13) -> tuple[np.ndarray, float, DataFrame, DataFrame]:
    """Singular values, total inertia (chi-square over n), and the principal coordinates of rows (i, mass, d1, d2, ...) and columns (j, mass, d1, ...).

    cells: i, j and n, a weight that isn't negative; repeated cells are added up, those of 0 or with a null left out. Beyond the rank of the table
    values and coordinates are 0. Each dimension's sign is as it comes.
    """
    t = settled(cells.where("i IS NOT NULL AND j IS NOT NULL AND n > 0").groupBy("i", "j").agg(F.sum(F.col("n").cast("double")).alias("n")))
    total = t.agg(F.sum("n")).first()[0] or 1.0
    names = [f"d{k + 1}" for k in range(dimensions + SPARE)]
    mass = {k: settled(t.groupBy(k).agg((F.sum("n") / total).alias("mass"))) for k in "ij"}
    w = t.join(mass["i"].withColumnRenamed("mass", "r"), "i").join(mass["j"].withColumnRenamed("mass", "c"), "j")
    w = settled(w.select("i", "j", (F.col("n") / total / F.sqrt(F.col("r") * F.col("c"))).alias("w")))
    inertia = float((w.agg(F.sum(F.col("w") * F.col("w"))).first()[0] or 1.0) - 1)

    def sent(x: DataFrame, frm: str, to: str) -> DataFrame:
        """The table (or its transpose) times the vectors, without the part along the roots of the masses."""
        got = w.join(x.drop("mass"), frm).groupBy(to).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in names])
        got = settled(got.join(mass[to], to))
        root = F.sqrt("mass")
        along = got.agg(*[F.sum(root * F.col(c)).alias(c) for c in names]).first() or [0.0] * len(names)
        return got.select(to, "mass", *[(F.col(c) - root * float(a or 0.0)).alias(c) for c, a in zip(names, along)])

    y = mass["j"].select("j", "mass", *[(F.pmod(F.xxhash64("j", F.lit(k)), F.lit(10**6)) / 5e5 - 1).alias(c) for k, c in enumerate(names)])
    was, values = None, np.zeros(len(names))
    for _ in range(rounds):
        x = settled(sent(y, "j", "i"))
        size, turn = np.linalg.eigh(_products(x, names))
        keep = size > 1e-24 * max(size.max(), 1e-300)
        x = _turned(x, "i", names, np.where(keep, turn / np.sqrt(np.where(keep, size, 1.0)), 0.0))
        y = settled(sent(x, "i", "j"), None if was is None else was)
        was = y
        size, turn = np.linalg.eigh(_products(y, names))
        size, turn = np.clip(size[::-1], 0, None), turn[:, ::-1]
        new = np.sqrt(size)
        still = np.abs(new**2 - values**2)[:dimensions].max(initial=0) <= eps * max(new.max() ** 2, 1e-300)  # squares: what is 0 stays below
        values = new
        if still:
            break
    rows, columns = _turned(x, "i", names, turn * values), _turned(y, "j", names, turn)
    shown = lambda df, k: df.select(k, "mass", *[(F.col(c) / F.sqrt("mass")).alias(c) for c in names[:dimensions]])
    out = settled(shown(rows, "i")), settled(shown(columns, "j"))
    for d in (w, t, y):
        discard(d)
    return np.where(values > 1e-9, values, 0.0)[:dimensions], inertia, *out

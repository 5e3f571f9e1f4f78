"""Smoothing of ordered series: windows for each series, named by by (or all rows as one series)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..functions.columns import folded
from ..plans.ordered import matches, neighbours, once
from .lowess import lowess as lowess  # noqa: PLC0414  one of the smoothers


def moving_average(df: DataFrame, x: str, weights: Sequence[float], order: str, name: str, by: Sequence[str] = (), ends: str = "shrink") -> DataFrame:
    """weights: of the row itself, of rows one away on either side, and so on. At the ends of a series missing neighbours are left out and the rest
    reweighted ("shrink"), or the row keeps its value ("keep"). A null counts as a missing neighbour."""
    half = len(weights) - 1
    values = {f"_{k}": (x, k) for k in range(-half, half + 1)}
    out = neighbours(df, order, values, by)
    here = [(F.col(f"_{k}").cast("double"), float(weights[abs(k)])) for k in range(-half, half + 1)]
    top = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in here), F.lit(0.0))
    base = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in here), F.lit(0.0))
    value = F.when(base != 0, top / base)
    if ends == "keep":
        whole = F.lit(True)
        for c, _ in here:
            whole = whole & c.isNotNull()
        value = F.when(whole, value).otherwise(F.col(x).cast("double"))
    return out.withColumn(name, value).drop(*values)


def _median(columns: Sequence[Column]) -> Column:
    a, n = F.array_sort(F.array(*columns)), len(columns)
    return F.get(a, F.lit(n // 2)) if n % 2 else (F.get(a, F.lit(n // 2 - 1)) + F.get(a, F.lit(n // 2))) / 2


def running_median(df: DataFrame, x: str, size: int, order: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The median of size rows around each (the even ones reach one further back); rows nearer to an end keep their value."""
    low = -(size // 2)
    values = {f"_{k}": (x, k) for k in range(low, low + size)}
    out = neighbours(df, order, values, by)
    whole = F.lit(True)
    for k in values:
        whole = whole & F.col(k).isNotNull()
    return out.withColumn(name, F.when(whole, _median([F.col(k).cast("double") for k in values])).otherwise(F.col(x).cast("double"))).drop(*values)


def hanning(df: DataFrame, x: str, order: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """A quarter, a half and a quarter; ends keep their value."""
    return moving_average(df, x, [0.5, 0.25], order, name, by, ends="keep")


def resistant(df: DataFrame, x: str, order: str, name: str, steps: str = "3H", by: Sequence[str] = ()) -> DataFrame:
    """Smoothers one after another: 2, 3, 4, 5 running medians, H Hanning. A step t smooths the rough that the steps before left and adds it back."""
    df = df.withColumn(name, F.col(x).cast("double"))
    plain = steps.replace("t", "")
    for s in plain:
        df = (hanning(df, name, order, "_next", by) if s == "H" else running_median(df, name, int(s), order, "_next", by)).withColumn(name, F.col("_next")).drop("_next")
    if "t" in steps:
        df = resistant(df.withColumn("_rough", F.col(x) - F.col(name)), "_rough", order, "_again", plain, by)
        df = df.withColumn(name, F.col(name) + F.col("_again")).drop("_rough", "_again")
    return df


def exponential(df: DataFrame, x: str, share: float, order: str, name: str, by: Sequence[str]) -> DataFrame:
    """Each value is share of the new one and the rest of the one before, folded over an array of each series."""
    started = F.lit(None).cast("double")
    return folded(df, lambda last, r: F.coalesce(share * r[x] + (1 - share) * last, r[x]), started, order, [x], name, by)


def _basis(t: np.ndarray, knots: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(t)), t, t**2, t**3, np.clip(t[:, None] - knots, 0, None) ** 3])


def spline(df: DataFrame, x: str, y: str, by: Sequence[str], smoothing: float = 1.0) -> DataFrame:
    """Penalised cubic regression spline over up to 28 knots at the quantiles of a series: by, x, y, smooth.

    Knots are one aggregate, the products of the basis another, which batches add up first; a series' small system is solved
    in one task, its rows are not gathered.
    """
    by = list(by)
    rows = df.dropna(subset=[x, y]).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    ends = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"), F.percentile_approx("_x", [k / 29 for k in range(1, 29)], 10_000).alias("_q"))
    span = F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-12))
    inner = F.filter(F.array_distinct("_q"), lambda q: (q > F.col("_low")) & (q < F.col("_high")))
    knots = once(ends.select(*by, "_n", "_low", span.alias("_span"), F.transform(inner, lambda q: (q - F.col("_low")) / span).alias("_k")))
    joined = matches(rows, knots, by) if by else rows.join(F.broadcast(knots))  # one row

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for key, part in f.groupby(by, dropna=False, sort=False) if by else [((), f)]:
                b = _basis((part["_x"] - part["_low"]).to_numpy() / part["_span"].to_numpy(), part["_k"].iloc[0])
                v = np.concatenate([(b.T @ b).ravel(), b.T @ part["_y"].to_numpy()])
                out = pd.DataFrame({c: [k] * len(v) for c, k in zip(by, key)} | {"_p": np.arange(len(v)), "_v": v})
                yield out.where(out.notna(), None) if by else out

    types = [rows.schema[c] for c in by]
    sums = joined.select(*by, "_x", "_y", "_low", "_span", "_k").mapInPandas(products, StructType([*types]).add("_p", "integer").add("_v", "double")).groupBy(*by, "_p").agg(F.sum("_v").alias("_v"))
    sums = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_p", "_v"))).alias("_s"))  # of bounded length
    sums = matches(sums, knots, by) if by else sums.join(F.broadcast(knots))
    sums = sums.select(*by, "_n", "_low", "_span", "_k", F.transform("_s", lambda e: e["_v"]).alias("_s"))

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            coef = []
            for n, k, s in zip(f["_n"], f["_k"], f["_s"]):
                m = 4 + len(k)
                penalty = np.diag([0.0] * 4 + [smoothing * 1e-4 * n] * len(k))
                coef.append(np.linalg.lstsq(np.reshape(s[: m * m], (m, m)) + penalty, np.asarray(s[m * m :]), rcond=None)[0].tolist())
            yield f.assign(_b=coef)[[*by, "_low", "_span", "_k", "_b"]]

    fits = sums.mapInPandas(solved, StructType([*types]).add("_low", "double").add("_span", "double").add("_k", ArrayType(DoubleType())).add("_b", ArrayType(DoubleType())))
    out = matches(rows, once(fits), by) if by else rows.join(F.broadcast(once(fits)))
    t = (F.col("_x") - F.col("_low")) / F.col("_span")
    cubes = F.aggregate(F.zip_with("_k", F.slice("_b", F.lit(5), F.size("_k")), lambda k, c: c * F.pow(F.greatest(t - k, F.lit(0.0)), F.lit(3.0))), F.lit(0.0), lambda s, v: s + v)
    line = sum((F.get("_b", F.lit(p)) * F.pow(t, F.lit(float(p))) for p in range(1, 4)), F.get("_b", F.lit(0)))
    return out.select(*by, F.col("_x").alias(x), F.col("_y").alias(y), (line + cubes).alias("smooth"))

"""Clusters of rows and of dissimilarities (edges i, j, v)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import settled
from .graphs import both_ways, components, levels, spanning_tree


def means(df: DataFrame, columns: Sequence[str], k: int, rounds: int = 50, seed: int = 1, tol: float = 1e-9) -> tuple[np.ndarray, DataFrame, float]:
    """Partition into k clusters of least squared distances: centres, df with cluster (from 0), and the sum of squares.

    Starting centres are rows drawn by hash, each far from those before it with the best of a few draws. A round is one aggregate of built-in
    functions; ties go to the first centre.
    """
    df = df.dropna(subset=list(columns))
    x = [F.col(c).cast("double") for c in columns]
    draw = df.select(*[c.alias(f"x{i}") for i, c in enumerate(x)]).distinct().orderBy(F.xxhash64(F.lit(seed), *[f"x{i}" for i in range(len(x))])).limit(20 * k).collect()
    pool = np.array([list(r) for r in draw], float).reshape(-1, len(x))
    if len(pool) < k:
        raise ValueError("fewer distinct rows than clusters")
    centres = pool[:1]
    while len(centres) < k:
        d = ((pool[:, None] - centres[None]) ** 2).sum(-1).min(1)
        centres = np.vstack([centres, pool[d.argmax()]])

    def distance(c: np.ndarray) -> Column:
        return sum(((v - float(t)) * (v - float(t)) for v, t in zip(x, c)), F.lit(0.0))

    def assigned(centres: np.ndarray) -> DataFrame:
        d = F.array(*[F.struct(distance(c).alias("d"), F.lit(j).alias("c")) for j, c in enumerate(centres)])
        return df.withColumn("_best", F.array_min(d))

    was = np.inf
    for _ in range(rounds):
        got = assigned(centres).groupBy(F.col("_best.c").alias("c")).agg(F.sum("_best.d").alias("d"), *[F.avg(v).alias(f"x{i}") for i, v in enumerate(x)]).collect()
        for r in got:
            centres[r.c] = [r[f"x{i}"] for i in range(len(x))]
        total = sum(r.d for r in got)
        if was - total <= tol * (1 + total):
            break
        was = total
    out = assigned(centres)
    return centres, out.withColumn("cluster", F.col("_best.c")).drop("_best"), float(out.agg(F.sum("_best.d")).first()[0])


def nearest(edges: DataFrame, k: int = 1) -> DataFrame:
    """i, j, v: of each node the k edges of least v (null: the largest), ties to the smaller node."""
    w = Window.partitionBy("i").orderBy(F.col("v").asc_nulls_last(), "j")
    return both_ways(edges).where("i <> j").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def nearest_neighbours(edges: DataFrame, k: int = 1, mutual: bool = False) -> DataFrame:
    """node, component: nodes linked to one of their k nearest (with mutual: if each is among the other's)."""
    n = nearest(edges, k)
    links = n.join(n.select(F.col("j").alias("i"), F.col("i").alias("j")), ["i", "j"]) if mutual else n
    all_ = edges.select(F.col("i").alias("node")).union(edges.select("j")).distinct()
    return components(links.select("i", "j", "v"), all_)


def single_linkage(edges: DataFrame, level: float) -> DataFrame:
    """node, component: single linkage cut at a level. The merging heights themselves are the values of spanning_tree()."""
    all_ = edges.select(F.col("i").alias("node")).union(edges.select("j")).distinct()
    return components(edges.where(F.col("v") <= level), all_)


def merging_heights(edges: DataFrame) -> DataFrame:
    """The heights at which single linkage merges clusters: i, j, v."""
    return spanning_tree(edges)


def metric_constant(edges: DataFrame) -> DataFrame:
    """One row: the least constant that, added to all dissimilarities, makes them obey the triangle inequality."""
    d = settled(both_ways(edges).where("i <> j").groupBy("i", "j").agg(F.min("v").alias("v")))
    via = d.alias("x").join(d.alias("y"), F.col("x.j") == F.col("y.i")).where("x.i <> y.j").groupBy(F.col("x.i").alias("i"), F.col("y.j").alias("j")).agg(F.min(F.col("x.v") + F.col("y.v")).alias("_s"))
    return d.join(via, ["i", "j"]).agg(F.greatest(F.lit(0.0), F.max(F.col("v") - F.col("_s"))).alias("constant"))


def leaves_at(edges: DataFrame, root: float, depth: int) -> DataFrame:
    """Parts of a tree's leaves: node, part (its ancestor at depth; itself if it is higher)."""
    up = settled(levels(edges, root))
    inner = edges.select(F.col("i").alias("node")).distinct()
    part = up.where(F.col("level") <= depth).select("node", F.col("node").alias("part"))
    now = up.where(F.col("level") == depth).select("node", F.col("node").alias("part"))
    deepest = up.agg(F.max("level")).first()[0] or 0
    for k in range(depth + 1, deepest + 1):
        now = up.where(F.col("level") == k).join(now.select(F.col("node").alias("parent"), "part"), "parent").select("node", "part")
        now = settled(now)
        part = part.union(now)
    return part.join(inner, "node", "left_anti")


#: Linkage: the weights of the two joined clusters' distances, of the distance between them, and of the difference of the two, by sizes p, q and the other's r.
LINKAGES = {
    "single": lambda p, q, r: (0.5, 0.5, 0.0, -0.5),
    "complete": lambda p, q, r: (0.5, 0.5, 0.0, 0.5),
    "average": lambda p, q, r: (p / (p + q), q / (p + q), 0.0, 0.0),
    "weighted": lambda p, q, r: (0.5, 0.5, 0.0, 0.0),
    "centroid": lambda p, q, r: (p / (p + q), q / (p + q), -p * q / (p + q) ** 2, 0.0),
    "median": lambda p, q, r: (0.5, 0.5, -0.25, 0.0),
    "ward": lambda p, q, r: ((p + r) / (p + q + r), (q + r) / (p + q + r), -r / (p + q + r), 0.0),
}


def hierarchical(edges: DataFrame, linkage: str = "average", by: Sequence[str] = (), most: int = 5000) -> DataFrame:
    """Joins of clusters of each block of dissimilarities (by, i, j, v, for every pair): by, step, a, b, v, size.

    a and b name clusters by their smallest node, a < b; ties go to the smallest. centroid, median and ward take squared distances. A block is
    one matrix in one task and may have at most that many nodes; single linkage of any number is single_linkage().
    """
    weights = LINKAGES[linkage]

    def one(f: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([f["i"], f["j"]]))
        n = len(nodes)
        if n > most:
            raise ValueError(f"a block of {n} nodes is beyond most ({most})")
        d = np.full((n, n), np.inf)
        i, j = np.searchsorted(nodes, f["i"]), np.searchsorted(nodes, f["j"])
        d[i, j] = d[j, i] = f["v"].to_numpy(float)
        np.fill_diagonal(d, np.inf)
        size, open_, out = np.ones(n), np.ones(n, bool), []
        for step in range(1, n):
            a, b = np.unravel_index(d.argmin(), d.shape)
            if not np.isfinite(d[a, b]):
                break
            v = d[a, b]
            out.append((step, nodes[a], nodes[b], v, int(size[a] + size[b])))
            p, q, between, apart = weights(size[a], size[b], size)
            with np.errstate(invalid="ignore"):
                new = p * d[a] + q * d[b] + between * v + (apart * np.abs(d[a] - d[b]) if apart else 0.0)
            open_[b], size[a] = False, size[a] + size[b]
            new[~open_ | np.isnan(new)] = np.inf
            new[a] = np.inf
            d[a], d[:, a], d[b], d[:, b] = new, new, np.inf, np.inf
        got = pd.DataFrame(out, columns=["step", "a", "b", "v", "size"])
        for c in reversed(by):
            got.insert(0, c, f[c].iloc[0])
        return got

    rows = edges.where("i <> j").select(*by, "i", "j", F.col("v").cast("double").alias("v"))
    kind = rows.schema["i"].dataType.simpleString()
    shape = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by), f"step int, a {kind}, b {kind}, v double, size int"])
    return rows.groupBy(*(by or [F.lit(1).alias("_all")])).applyInPandas(one, shape)

"""Exact top-k inner products by a pivot-distance index.

One more component makes all vectors equally long, so that the largest inner product is the
smallest distance. Each vector is keyed by its nearest pivot and its distance from it, and
the vectors of a pivot are parted into annuli by distance. A query searches the annulus
that it falls in; the k-th score found there bounds, by the triangle inequality, which
other annuli can hold anything better. Inside an annulus the sorted blocks are expanded
outwards from the query's own distance and stopped by the same bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Bounds of the number of pivots and of annuli of each, which follow the number of vectors; their product bounds the cells, whose
#: outlines are sent to the tasks.
PIVOTS, ANNULI = (8, 256), (4, 64)
#: Vectors and queries at most that meet in one group, about; larger cells are parted by hashes.
CHUNK, QUERIES = 8192, 2048
BLOCK = 256


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and the components times 256, rounded down (array of double). Rows with a null id or vector, or with null
    or non-finite components (times 256, as doubles), are left out. Shorter vectors count as filled up with zeros."""
    big = lambda x: 256 * x.cast("double")
    whole = lambda x: F.when(F.abs(big(x)) < 2.0**53, F.floor(big(x)).cast("double")).otherwise(big(x))  # noqa: E731  beyond, all doubles are whole
    ok = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(big(x)) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ok).select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), whole).alias("v"))


def _matrix(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    rows = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else list(column)
    if rows and all(len(r) == dim for r in rows):
        return np.array(rows, np.float64).reshape(-1, dim)
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _scores(part: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products; where doubles don't hold them, whole numbers of any size."""
    if exact:
        return np.rint(part @ q)
    whole = np.frompyfunc(int, 1, 1)
    return whole(part) @ whole(q) if len(part) else np.empty(0, object)


def _search(vid: np.ndarray, vec: np.ndarray, dist: np.ndarray, qid: np.ndarray, q: np.ndarray, qdist: np.ndarray, floor: np.ndarray, m2: float, k: int) -> pd.DataFrame:
    """The k best of these vectors for each query, floor: a score that k vectors of other cells reach."""
    order = np.lexsort((vid, dist))
    vid, vec, dist = vid[order], vec[order], dist[order]
    starts = np.arange(0, len(vid), BLOCK)
    lows, highs = dist[starts], dist[np.minimum(starts + BLOCK, len(vid)) - 1]
    out = []
    for i in range(len(qid)):
        gap = np.maximum(0, np.maximum(lows - qdist[i], qdist[i] - highs))
        q2 = float(q[i] @ q[i])
        exact = q2 * m2 < 2.0**104  # no sum of products is beyond 2^52
        # |q - x|^2 = q2 + m2 - 2 score is at least gap^2; the margin is for rounding
        most = (q2 + m2 - np.maximum(0, gap - 1e-6 * (1 + gap)) ** 2) / 2 + 1e-6 * (1 + m2)
        best_s, best_v, need = np.empty(0), np.empty(0, np.int64), floor[i]
        for b in np.argsort(gap, kind="stable"):
            if most[b] < need:
                break
            part = slice(starts[b], starts[b] + BLOCK)
            s, v = _scores(vec[part], q[i], exact), vid[part]
            ok = (s >= need) & (v != qid[i])
            if ok.any():
                s, v = np.concatenate([best_s, s[ok]]), np.concatenate([best_v, v[ok]])
                keep_ = np.lexsort((v, -s))[:k]
                best_s, best_v = s[keep_], v[keep_]
                if len(best_s) == k:
                    need = max(need, best_s[-1])
        out.append((np.full(len(best_v), qid[i]), best_v, np.clip(best_s, -(1 << 63), (1 << 63) - 1).astype(np.int64) if not exact else best_s.astype(np.int64)))
    cols = [np.concatenate([o[c] for o in out]) if out else np.empty(0, np.int64) for c in range(3)]
    return pd.DataFrame({"query_id": cols[0].astype(np.int64), "vec_id": cols[1].astype(np.int64), "score": cols[2]})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors and queries as usable() gives them. query_id, rank, vec_id, score: each query's k highest inner products
    (all, if fewer), ties to the smaller id; a vector is no candidate for the query of its own id.

    Scores are exact and in exact order; one beyond the range of long is given as its end. Without vectors or queries the result
    is empty. Repeated rows are candidates each; of several queries of one id the smallest vector is asked.
    """
    spark = vectors.sparkSession
    shape = "query_id long, rank int, vec_id long, score long"
    facts = vectors.agg(F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m2"), F.count("*").alias("n")).first()
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    widest = queries.agg(F.max(F.size("v"))).first()[0]
    if facts.dim is None or widest is None:
        return spark.createDataFrame([], shape)
    dim, m2 = max(facts.dim, widest, 1), facts.m2
    n_pivots = min(max(math.isqrt(facts.n) // 8, PIVOTS[0]), PIVOTS[1])
    annuli = min(max(facts.n // (n_pivots * CHUNK // 4), ANNULI[0]), ANNULI[1])
    pivots = _matrix(pd.Series([r.v for r in vectors.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()]), dim)
    pivots = np.hstack([pivots, np.sqrt(np.maximum(0, m2 - (pivots**2).sum(1)))[:, None]])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            x = np.hstack([x, np.sqrt(np.maximum(0, m2 - (x**2).sum(1)))[:, None]])
            d = np.sqrt(np.maximum(0, m2 + m2 - 2 * x @ pivots.T))
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(d[np.arange(len(x)), near])], names=["id", "v", "pivot", "dist"])

    index = keep(vectors.select("id", "v").mapInArrow(keyed, "id long, v array<double>, pivot int, dist double"))
    found = index.groupBy("pivot").agg(F.percentile_approx("dist", [i / annuli for i in range(1, annuli)], 1000).alias("cuts")).collect()  # as many as pivots
    cuts = {r.pivot: np.unique(r.cuts) for r in found}

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivot, dist = b.column(2).to_numpy(), b.column(3).to_numpy()
            ring = np.zeros(len(pivot), np.int64)
            for p in np.unique(pivot):
                ring[pivot == p] = np.searchsorted(cuts[int(p)], dist[pivot == p], "right")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(pivot * annuli + ring, pa.int32())], names=["id", "v", "dist", "cell"])

    index = index.mapInArrow(celled, "id long, v array<double>, dist double, cell int")
    cells = index.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).orderBy("cell").collect()
    of, low, high = (np.array([r[c] for r in cells]) for c in ("cell", "low", "high"))
    parts = np.array([-(-r.n // CHUNK) for r in cells])
    pivot_of = of // annuli
    outlines = spark.createDataFrame([(int(c), int(p)) for c, p in zip(of, parts)], "cell int, chunks int")  # at most as many as pivots times annuli
    index = index.join(F.broadcast(outlines), "cell").withColumn("chunk", F.pmod(F.xxhash64("id", "dist"), F.col("chunks").cast("long")).cast("int")).drop("chunks")

    def places(home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q = _matrix(b.column(1), dim)
                q2 = (q**2).sum(1)
                d = np.sqrt(np.maximum(0, q2[:, None] + m2 - 2 * np.hstack([q, np.zeros((len(q), 1))]) @ pivots.T))[:, pivot_of]
                gap = np.maximum(0, np.maximum(low - d, d - high))
                own = (gap + 1e-9 * d).argmin(1)
                if home:
                    i, c = np.arange(len(q)), own
                else:
                    most = (q2[:, None] + m2 - np.maximum(0, gap - 1e-6 * (1 + gap)) ** 2) / 2 + 1e-6 * (1 + m2)
                    hit = most >= np.array(b.column(2).to_pylist(), np.float64)[:, None]
                    hit[np.arange(len(q)), own] = False
                    i, c = np.nonzero(hit)
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(of[c], pa.int32()), pa.array(d[i, c], pa.float64())], names=["id", "v", "floor", "cell", "dist"])

        return run

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return _search(left["id"].to_numpy(), _matrix(left["v"], dim), left["dist"].to_numpy(), right["id"].to_numpy(), _matrix(right["v"], dim), right["dist"].to_numpy(), right["floor"].to_numpy(), m2, k)

    def searched(asked: DataFrame, home: bool) -> DataFrame:
        """A cell's vectors meet the queries that ask for the cell, in as many parts as these need."""
        to = keep(asked.mapInArrow(places(home), "id long, v array<double>, floor double, cell int, dist double"))
        plan = to.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")).join(F.broadcast(outlines), "cell")
        plan = F.broadcast(plan)
        ready = index.join(plan.select("cell", "parts"), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        to = to.join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).cast("int"))
        to = to.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        one = lambda df, *more: df.select("id", "v", "dist", *more, "cell", "chunk", "part").groupBy("cell", "chunk", "part")
        return one(ready).cogroup(one(to, "floor")).applyInPandas(meet, "query_id long, vec_id long, score long")

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    queries = keep(queries.withColumn("floor", F.lit(float("-inf"))))
    first = keep(ranked(searched(queries, True)).select("query_id", "vec_id", "score"))
    floors = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score").cast("double")).alias("f"))
    asked = queries.join(floors, F.col("id") == F.col("query_id"), "left").select("id", "v", F.coalesce("f", "floor").alias("floor"))
    return ranked(first.union(searched(asked, False))).select("query_id", "rank", "vec_id", "score")

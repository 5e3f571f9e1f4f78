"""Matrices as rows i, j, v (from 1). Small dense ones are numpy's business; these are for matrices that don't fit in the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.iterate import settled
from ..plans.ordered import attached, positions, running
from .survival import product_limit


def from_rows(df: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """Rows in the order of a column, a column of the matrix for each of columns."""
    rows = positions(df.select(F.col(order).alias("_order"), *[F.col(c).cast("double").alias(c) for c in columns]), "_order", "i")
    cells = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("j"), F.col(c).alias("v")) for k, c in enumerate(columns, 1)])).alias("_x")
    return rows.select("i", cells).select("i", "_x.j", "_x.v")


def from_array(spark: SparkSession, a: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i + 1, j + 1, float(v)) for (i, j), v in np.ndenumerate(np.atleast_2d(a))], "i long, j long, v double")


def to_array(m: DataFrame, most: int = 1_000_000) -> np.ndarray:
    """A matrix of up to most entries in the driver."""
    rows = m.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} entries")
    out = np.zeros((max((r.i for r in rows), default=0), max((r.j for r in rows), default=0)))
    for r in rows:
        out[r.i - 1, r.j - 1] = r.v
    return out


def constant(spark: SparkSession, m: int, n: int, value: float) -> DataFrame:
    return spark.range(1, m + 1).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("j"), F.lit(float(value)).alias("v"))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def transposed(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def combined(a: DataFrame, b: DataFrame, x: float = 1.0, y: float = 1.0) -> DataFrame:
    """x a + y b; entries that are missing are 0."""
    return a.select("i", "j", (F.col("v") * x).alias("v")).unionByName(b.select("i", "j", (F.col("v") * y).alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v"))


def elementwise(a: DataFrame, b: DataFrame, f) -> DataFrame:
    return a.select("i", "j", F.col("v").alias("_a")).join(b.select("i", "j", F.col("v").alias("_b")), ["i", "j"]).select("i", "j", f(F.col("_a"), F.col("_b")).alias("v"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("i", F.col("j").alias("_k"), F.col("v").alias("_a")), b.select(F.col("i").alias("_k"), "j", F.col("v").alias("_b"))
    return left.join(right, "_k").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def cross(a: DataFrame) -> DataFrame:
    """The transpose times the matrix itself."""
    return product(transposed(a), a)


def kronecker(a: DataFrame, b: DataFrame, rows: int, columns: int) -> DataFrame:
    """rows and columns of b; every entry of a meets every one of b, as in the result."""
    y = b.select(F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("v").alias("_v"))
    return a.join(y).select(((F.col("i") - 1) * rows + F.col("_i")).alias("i"), ((F.col("j") - 1) * columns + F.col("_j")).alias("j"), (F.col("v") * F.col("_v")).alias("v"))


def row_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("i").agg(F.sum("v").alias("v"))


def column_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("j").agg(F.sum("v").alias("v"))


def diagonal(m: DataFrame) -> DataFrame:
    return m.where("i = j").select("i", "v")


def as_diagonal(vector: DataFrame, index: str = "i") -> DataFrame:
    """The matrix with a vector (index, v) on its diagonal."""
    return vector.select(F.col(index).alias("i"), F.col(index).alias("j"), "v")


def root_diagonal(m: DataFrame, inverse: bool = False) -> DataFrame:
    """The roots of the diagonal's entries, or their inverses; null for negative ones (for 0, if inverse)."""
    v = F.when(F.col("v") >= 0, F.sqrt("v"))
    return m.where("i = j").select("i", "j", (F.when(v > 0, 1 / v) if inverse else v).alias("v"))


def facts(m: DataFrame) -> DataFrame:
    """One row: rows, columns, trace, largest (absolute entry), absolute_sum, frobenius, sum."""
    v = F.col("v")
    return m.agg(F.max("i").alias("rows"), F.max("j").alias("columns"), F.coalesce(F.sum(F.when(F.col("i") == F.col("j"), v)), F.lit(0.0)).alias("trace"), F.max(F.abs(v)).alias("largest"), F.sum(F.abs(v)).alias("absolute_sum"), F.sqrt(F.sum(v * v)).alias("frobenius"), F.sum(v).alias("sum"))


def centred(m: DataFrame, scale: bool = False) -> DataFrame:
    """Columns less their mean and, with scale, by their standard deviation (kept where that is 0)."""
    stats = m.groupBy("j").agg(F.avg("v").alias("_m"), F.stddev_samp("v").alias("_s"))
    v = F.col("v") - F.col("_m")
    return m.join(stats, "j").select("i", "j", (F.when(F.col("_s") > 0, v / F.col("_s")).otherwise(v) if scale else v).alias("v"))


def double_centred(m: DataFrame) -> DataFrame:
    rows, cols = m.groupBy("i").agg(F.avg("v").alias("_r")), m.groupBy("j").agg(F.avg("v").alias("_c"))
    return attached(m, _g=F.avg("v")).join(rows, "i").join(cols, "j").select("i", "j", (F.col("v") - F.col("_r") - F.col("_c") + F.col("_g")).alias("v"))


def shares(m: DataFrame) -> DataFrame:
    return attached(m, _t=F.sum("v")).select("i", "j", (F.col("v") / F.col("_t")).alias("v"))


def zeroed(m: DataFrame, condition: Column) -> DataFrame:
    return m.withColumn("v", F.when(condition, 0.0).otherwise(F.col("v")))


def grouped(m: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Sums by groups of rows and columns, both given as (index, group)."""
    r, c = rows.select(F.col("index").alias("i"), F.col("group").alias("_r")), columns.select(F.col("index").alias("j"), F.col("group").alias("_c"))
    return m.join(r, "i").join(c, "j").groupBy(F.col("_r").alias("i"), F.col("_c").alias("j")).agg(F.sum("v").alias("v"))


def stacked(m: DataFrame, rows: int, columns: int, by_rows: bool = False) -> DataFrame:
    """One column: the columns (or rows) of the matrix, one under the other."""
    place = (F.col("i") - 1) * columns + F.col("j") if by_rows else (F.col("j") - 1) * rows + F.col("i")
    return m.select(place.alias("i"), F.lit(1).cast("long").alias("j"), "v")


def unstacked(vector: DataFrame, rows: int) -> DataFrame:
    """The matrix of which stacked() made a vector."""
    k = F.col("i") - 1
    return vector.select((k % rows + 1).alias("i"), (F.floor(k / rows) + 1).alias("j"), "v")


def beside(a: DataFrame, b: DataFrame, columns: int) -> DataFrame:
    return a.select("i", "j", "v").unionByName(b.select("i", (F.col("j") + columns).alias("j"), "v"))


def below(a: DataFrame, b: DataFrame, rows: int) -> DataFrame:
    return a.select("i", "j", "v").unionByName(b.select((F.col("i") + rows).alias("i"), "j", "v"))


def direct_sum(a: DataFrame, b: DataFrame, rows: int, columns: int) -> DataFrame:
    return a.select("i", "j", "v").unionByName(b.select((F.col("i") + rows).alias("i"), (F.col("j") + columns).alias("j"), "v"))


def permuted(m: DataFrame, permutation: DataFrame, rows: bool = True, columns: bool = False) -> DataFrame:
    """Entry (k, .) of the result is entry (p(k), .) of m; permutation: k, p."""
    p = permutation.select("k", "p")
    if rows:
        m = m.join(p, F.col("i") == F.col("p")).select(F.col("k").alias("i"), "j", "v")
    if columns:
        m = m.join(p, F.col("j") == F.col("p")).select("i", F.col("k").alias("j"), "v")
    return m


def inverse_permutation(permutation: DataFrame) -> DataFrame:
    return permutation.select(F.col("p").alias("k"), F.col("k").alias("p"))


def sorting_permutation(m: DataFrame, column: int) -> DataFrame:
    """k, p: the k-th row in the order of a column (ties by row) is row p."""
    rows = m.where(F.col("j") == column).select(F.col("i").alias("p"), "v")
    cells = running(rows.groupBy("v").agg(F.count("*").alias("_n")), "v", {"_b": F.col("_n")}, exclusive=True)
    inside = F.row_number().over(Window.partitionBy("v").orderBy("p"))
    return rows.join(cells, "v").select((F.col("_b") + inside).alias("k"), "p")


def edges(m: DataFrame, least: float) -> DataFrame:
    """Edges i, j, v for entries from least on."""
    return m.where(F.col("v") >= least)


def tail_means(vector: DataFrame) -> DataFrame:
    """vector: i, a, w. For each i the mean of later a weighted by w; a itself where there is no weight: i, v."""
    out = running(vector, "i", {"_w": F.col("w").cast("double"), "_wa": F.col("w") * F.col("a").cast("double")}, descending=True, exclusive=True)
    return out.select("i", F.when(F.col("_w") != 0, F.col("_wa") / F.col("_w")).otherwise(F.col("a").cast("double")).alias("v"))


def means_above(vector: DataFrame) -> DataFrame:
    """vector: i, a, w, t. For each i the mean of a weighted by w over the rows of a larger t; a itself where there is no weight: i, v."""
    w, a = F.col("w").cast("double"), F.col("a").cast("double")
    sums = vector.groupBy("t").agg(F.sum(w).alias("_w"), F.sum(w * a).alias("_wa"))
    above = running(settled(sums), "t", {"_ws": F.col("_w"), "_was": F.col("_wa")}, descending=True, exclusive=True).select("t", "_ws", "_was")
    return vector.join(above, "t").select("i", F.when(F.col("_ws") != 0, F.col("_was") / F.col("_ws")).otherwise(a).alias("v"))


def fitted_to_margins(m: DataFrame, rows: DataFrame, columns: DataFrame, rounds: int = 100, eps: float = 1e-9) -> DataFrame:
    """Rows and columns scaled in turn until sums are those of rows (i, v) and columns (j, v)."""
    a = settled(m.select("i", "j", F.col("v").cast("double").alias("v")))
    r, c = rows.select("i", F.col("v").alias("_want")), columns.select("j", F.col("v").alias("_want"))
    for _ in range(rounds):
        was = a
        for keys, want in ((["i"], r), (["j"], c)):
            have = a.groupBy(*keys).agg(F.sum("v").alias("_have")).join(want, keys)
            a = a.join(have, keys).select("i", "j", F.when(F.col("_have") != 0, F.col("v") * F.col("_want") / F.col("_have")).otherwise(0.0).alias("v"))
        a = settled(a)
        moved = a.join(was.select("i", "j", F.col("v").alias("_w")), ["i", "j"]).agg(F.max(F.abs(F.col("v") - F.col("_w")))).first()[0]
        if (moved or 0.0) <= eps:
            break
    return a


def per_block(df: DataFrame, block: str, columns: Sequence[str], f, schema: str) -> DataFrame:
    """f(numpy matrix) -> numpy matrix for each block of rows; schema names the result's columns, after the block."""
    names = [p.split()[0] for p in schema.split(",")]

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(np.atleast_2d(f(frame[list(columns)].to_numpy(float))), columns=names)
        out.insert(0, block, frame[block].iloc[0])
        return out

    return df.select(block, *columns).groupBy(block).applyInPandas(one, f"{block} {dict(df.dtypes)[block]}, {schema}")


def projected_population(start: np.ndarray, fertility: np.ndarray, survival: np.ndarray, steps: int, spark: SparkSession, migration: np.ndarray | None = None) -> DataFrame:
    """step, age, n: a population moved on by age-specific fertility and survival (and net migration). A row for each step and age."""
    n, rows = np.asarray(start, float), []
    for t in range(steps + 1):
        rows += [(t, a, float(v)) for a, v in enumerate(n)]
        n = np.concatenate([[fertility @ n], survival[: len(n) - 1] * n[:-1]]) + (0 if migration is None else migration)
    return spark.createDataFrame(rows, "step int, age int, n double")


def rank_distances(rankings: DataFrame, id: str, item: str, rank: str) -> DataFrame:
    """a, b, distance between rankings: the pairs of items that the two put in opposite order count 2, those tied in one alone 1. rankings: a row for each id and item.

    Items are compared inside each ranking first, so that pairs of rankings meet by pairs of items.
    """
    r = rankings.select(F.col(id).alias("id"), F.col(item).alias("item"), F.col(rank).alias("rank"))
    two = r.alias("x").join(r.alias("y"), (F.col("x.id") == F.col("y.id")) & (F.col("x.item") < F.col("y.item"))).select(F.col("x.id").alias("id"), F.col("x.item").alias("p"), F.col("y.item").alias("q"), F.signum(F.col("x.rank") - F.col("y.rank")).alias("s"))
    both = two.alias("u").join(two.alias("w"), (F.col("u.p") == F.col("w.p")) & (F.col("u.q") == F.col("w.q")) & (F.col("u.id") < F.col("w.id")))
    return both.groupBy(F.col("u.id").alias("a"), F.col("w.id").alias("b")).agg(F.sum(F.abs(F.col("u.s") - F.col("w.s"))).cast("long").alias("distance"))


def product_limit_distribution(df: DataFrame, t: str, censored: str) -> DataFrame:
    """t and the distribution function of times where censored is 0."""
    e = df.select(F.lit(0.0).alias("ts"), F.col(t).cast("double").alias("tf"), F.lit(0).alias("org"), F.when(F.col(censored) == 0, 1).otherwise(0).alias("des"))
    return product_limit(e).select(F.col("time").alias("t"), (1 - F.col("survivor")).alias("distribution"))


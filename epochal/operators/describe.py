"""Descriptive statistics: moments, order statistics, tables, association, inequality, segregation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fitting import gram
from ..plans.ordered import bucket_of, cuts, matches, once, running, sums_before


def _w(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """A row for each column and group: variable, n, min, max, mean, std (sample; by the sum of weights less 1, 0 unless that is above 0), sum.

    One pass: squares are summed around each column's group mean by Spark's own variance where there are no weights,
    else by a second aggregate joined to the means.
    """
    def packed(parts: dict[str, list[Column]]) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), *v) for c, v in parts.items()])).alias("_x")

    if weight is None:
        aggs = [a for c in columns for a in (F.count(c).alias(f"n_{c}"), F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"), F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"), F.sum(c).alias(f"t_{c}"))]
        got = df.groupBy(*by).agg(*aggs)
    else:
        w = _w(weight)
        means = df.groupBy(*by).agg(*[(F.sum(w * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), w))).alias(f"_m_{c}") for c in columns])
        df = matches(df, means, list(by)) if by else df.join(F.broadcast(means))
        aggs = []
        for c in columns:
            x, seen = F.col(c), F.sum(F.when(F.col(c).isNotNull(), w))
            spread = F.sum(w * F.pow(x - F.col(f"_m_{c}"), F.lit(2.0)))
            aggs += [F.count(c).alias(f"n_{c}"), F.min(c).alias(f"a_{c}"), F.max(c).alias(f"b_{c}"), F.max(f"_m_{c}").alias(f"m_{c}"), F.when(seen > 1, F.sqrt(spread / (seen - 1))).otherwise(0.0).alias(f"s_{c}"), F.sum(w * x).alias(f"t_{c}")]
        got = df.groupBy(*by).agg(*aggs)
    d = lambda s: F.col(s).cast("double")
    parts = {c: [F.col(f"n_{c}").alias("n"), d(f"a_{c}").alias("min"), d(f"b_{c}").alias("max"), d(f"m_{c}").alias("mean"), F.coalesce(d(f"s_{c}"), F.lit(0.0)).alias("std"), d(f"t_{c}").alias("sum")] for c in columns}
    return got.select(*by, packed(parts)).select(*by, "_x.*")


def quantiles(df: DataFrame, column: str, shares: Sequence[float] = (0.1, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9), by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles at place share * (n + 1), interpolated, held within the smallest and largest value: by, share, value.

    Distinct values are counted first; places are found by running counts, so no group is gathered.
    """
    cells = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    cells = running(cells, column, {"_upto": F.col("_n")}, by)
    n = cells.groupBy(*by).agg(F.sum("_n").alias("_all"))
    cells = matches(cells, n, list(by)) if by else cells.join(F.broadcast(n))
    aggs = []
    for k, q in enumerate(shares):
        place = F.least(F.greatest(F.lit(float(q)) * (F.col("_all") + 1), F.lit(1.0)), F.col("_all").cast("double"))
        low = F.floor(place)
        at = lambda p: F.max(F.when((F.col("_upto") >= p) & (F.col("_upto") - F.col("_n") < p), F.col(column)))
        aggs += [at(low).alias(f"_a{k}"), at(F.least(low + 1, F.col("_all"))).alias(f"_b{k}"), F.max(place - low).alias(f"_f{k}")]
    got = cells.groupBy(*by).agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("share"), ((1 - F.col(f"_f{k}")) * F.col(f"_a{k}") + F.col(f"_f{k}") * F.col(f"_b{k}")).alias("value")) for k, q in enumerate(shares)]))
    return got.select(*by, rows.alias("_x")).select(*by, "_x.*")


def frequencies(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """The joint table of columns: n (sum of weights), percent, cumulated and cumulated_percent in the order of the columns.
    Rows whose first column is null are left out, of the shares too."""
    first, rest = columns[0], list(columns[1:])
    cells = df.groupBy(*columns).agg((F.count("*") if weight is None else F.sum(_w(weight))).alias("n"))
    heads = cells.groupBy(first).agg(F.sum("n").alias("_n"))
    dense = heads.where(F.col(first).isNotNull())
    if dict(df.dtypes)[first] == "string":  # strings have no numeric cut points
        before = sums_before(dense, first, {"_before": "_n"})
    else:
        before = running(dense, first, {"_before": F.col("_n")}, exclusive=True)
    cells = cells.join(before.drop("_n"), first)
    inside = F.sum("n").over(Window.partitionBy(first).orderBy(*rest).rowsBetween(Window.unboundedPreceding, 0)) if rest else F.col("n")
    cells = cells.withColumn("cumulated", F.col("_before") + inside).drop("_before")
    cells = cells.join(F.broadcast(cells.agg(F.sum("n").alias("_all"))))
    return cells.withColumns({"percent": 100 * F.col("n") / F.col("_all"), "cumulated_percent": 100 * F.col("cumulated") / F.col("_all")}).drop("_all")


def crosstab(df: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """The cells of x and y with n, row_percent, column_percent and expected."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.sum(_w(weight)).alias("n"))
    rows, cols = cells.groupBy(x).agg(F.sum("n").alias("_r")), cells.groupBy(y).agg(F.sum("n").alias("_c"))
    out = cells.join(rows, x).join(cols, y).join(F.broadcast(cells.agg(F.sum("n").alias("_t"))))
    return out.select(x, y, "n", (100 * F.col("n") / F.col("_r")).alias("row_percent"), (100 * F.col("n") / F.col("_c")).alias("column_percent"), (F.col("_r") * F.col("_c") / F.col("_t")).alias("expected"))


def association(df: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """One row of measures for the table of x and y: n, chi2, lr, df, phi, cramer_v, contingency, lambda_x, lambda_y, lambda_sym, tau_y
    (of y given x), uncertainty_y, kendall_tau_b, gamma, somers_y.

    Only the table of cells is worked on, whose size is the product of the categories; ordered pairs are counted
    by cumulative sums along both of its sides.
    """
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.sum(_w(weight)).alias("n"))
    xs, ys = cells.groupBy(x).agg(F.sum("n").alias("r")), cells.groupBy(y).agg(F.sum("n").alias("c"))
    grid = xs.join(ys).join(cells, [x, y], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))
    below = Window.partitionBy(x).orderBy(y).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumns({"_low": F.coalesce(F.sum("n").over(below), F.lit(0.0))}).withColumn("_high", F.col("r") - F.col("_low") - F.col("n"))
    left = Window.partitionBy(y).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumns({"_con": F.coalesce(F.sum("_low").over(left), F.lit(0.0)), "_dis": F.coalesce(F.sum("_high").over(left), F.lit(0.0))})
    total = cells.agg(F.sum("n").alias("t"))
    e = F.col("r") * F.col("c") / F.col("t")
    sums = grid.join(F.broadcast(total)).agg(
        F.max("t").alias("t"), F.sum(F.pow(F.col("n") - e, F.lit(2.0)) / e).alias("chi2"), (2 * F.sum(F.when(F.col("n") > 0, F.col("n") * F.log(F.col("n") / e)).otherwise(0.0))).alias("lr"),
        F.sum(F.col("n") * F.col("_con")).alias("con"), F.sum(F.col("n") * F.col("_dis")).alias("dis"), F.sum(F.col("n") * F.col("n") / F.col("r")).alias("gk"),
    )
    rows = xs.agg(F.count("*").alias("nx"), F.max("r").alias("rmax"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("r") * F.log("r")).alias("rlog"))
    cols = ys.agg(F.count("*").alias("ny"), F.max("c").alias("cmax"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum(F.col("c") * F.log("c")).alias("clog"))
    tops = cells.groupBy(x).agg(F.max("n").alias("m")).agg(F.sum("m").alias("best_y"))
    tops2 = cells.groupBy(y).agg(F.max("n").alias("m")).agg(F.sum("m").alias("best_x"))
    one = sums.join(rows).join(cols).join(tops).join(tops2)
    c, t = F.col, F.col("t")
    k = F.least("nx", "ny") - 1
    ratio = lambda a, b: F.when(b != 0, a / b)
    hy = t * F.log(t) - c("clog")
    pairs, tx, ty = t * t, c("rr"), c("cc")
    return one.select(
        t.alias("n"), "chi2", "lr", ((c("nx") - 1) * (c("ny") - 1)).cast("long").alias("df"), F.sqrt(c("chi2") / t).alias("phi"), F.sqrt(ratio(c("chi2"), t * k)).alias("cramer_v"), F.sqrt(c("chi2") / (c("chi2") + t)).alias("contingency"),
        ratio(c("best_x") - c("rmax"), t - c("rmax")).alias("lambda_x"), ratio(c("best_y") - c("cmax"), t - c("cmax")).alias("lambda_y"), ratio(c("best_x") + c("best_y") - c("rmax") - c("cmax"), 2 * t - c("rmax") - c("cmax")).alias("lambda_sym"),
        ratio(c("gk") - ty / t, t - ty / t).alias("tau_y"), ratio(c("lr") / 2, hy).alias("uncertainty_y"),
        ratio(2 * (c("con") - c("dis")), F.sqrt((pairs - tx) * (pairs - ty))).alias("kendall_tau_b"), ratio(c("con") - c("dis"), c("con") + c("dis")).alias("gamma"), ratio(2 * (c("con") - c("dis")), pairs - tx).alias("somers_y"),
    )


def binned(df: DataFrame, x: str, points: Sequence[float], y: str | None = None, weight: str | None = None, left_closed: bool = True, drop_empty: bool = False) -> DataFrame:
    """Intervals between points: bin, low, high, n, weighted, mean_x, mean_y. Values outside all intervals aren't counted."""
    spark, p = df.sparkSession, [float(v) for v in points]
    c = F.col(x).cast("double")
    place = bucket_of(c, p) if not left_closed else F.lit(0)
    if left_closed:
        for v in p:
            place = place + F.when(c >= v, 1).otherwise(0)
    w = _w(weight)
    got = df.where(c.isNotNull()).groupBy((place - 1).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(w).alias("weighted"), (F.sum(w * c) / F.sum(w)).alias("mean_x"), ((F.sum(w * F.col(y)) / F.sum(w)) if y else F.lit(None).cast("double")).alias("mean_y"))
    edges = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(p, p[1:]))], "bin int, low double, high double")
    out = edges.join(got, "bin", "inner" if drop_empty else "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "weighted": F.coalesce("weighted", F.lit(0.0))})


def covariances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """x, y, covariance (n - 1) and correlation (-2 where a column doesn't vary) for each pair, rows with a null left out; one aggregate."""
    df = df.dropna(subset=list(columns))
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[: k + 1]]
    one = df.agg(*[F.covar_samp(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns])
    corr = lambda k, a, b: F.when((F.col(f"s_{a}") > 0) & (F.col(f"s_{b}") > 0), F.col(f"c{k}") / (F.col(f"s_{a}") * F.col(f"s_{b}"))).otherwise(-2.0)
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{k}").alias("covariance"), corr(k, a, b).alias("correlation")) for k, (a, b) in enumerate(pairs)])).alias("_x")).select("_x.*")


def _concordance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The sum over pairs of w w sign sign: at each bit of x's rank, pairs that part there meet by running sums over y."""
    rank = np.unique(x, return_inverse=True)[1]
    total = 0.0
    for bit in range(int(rank.max()).bit_length() if len(rank) else 0):
        group, right = rank >> (bit + 1), (rank >> bit) & 1
        order = np.lexsort((right, y, group))
        g, r, ys, ws = group[order], right[order], y[order], w[order]
        left = np.where(r == 0, ws, 0.0)
        run = np.concatenate([[0.0], np.cumsum(left)])
        starts = np.flatnonzero(np.diff(g, prepend=-1))
        ends = np.append(starts[1:], len(g))
        size = ends - starts
        g0, g1 = np.repeat(run[starts], size), np.repeat(run[ends], size)
        ties = np.flatnonzero((np.diff(g, prepend=-1) != 0) | (np.diff(ys, prepend=np.nan) != 0))
        tie_ends = np.append(ties[1:], len(g))
        below, upto = np.repeat(run[ties], tie_ends - ties), np.repeat(run[tie_ends], tie_ends - ties)
        total += float(np.sum(np.where(r == 1, ws * ((below - g0) - (g1 - upto)), 0.0)))
    return total


def rank_correlation(df: DataFrame, x: str, y: str, buckets: int = 32) -> DataFrame:
    """Kendall's tau-a of x and y (n, tau): the mean of sign(dx) sign(dy) over pairs of rows; ties count 0.

    Pairs are never made. Rows are counted by distinct (x, y) and cut into buckets along both; pairs in different
    buckets of both are counted on the grid of buckets, pairs in one bucket of x inside that group, and pairs in
    one bucket of y but different ones of x inside that. A bucket of one value alone has no pair that counts.
    """
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count("*").cast("double").alias("w"))
    cells = cells.withColumns({"bx": bucket_of(F.col("x"), cuts(cells, F.col("x"), buckets)), "by": bucket_of(F.col("y"), cuts(cells, F.col("y"), buckets))})

    def inside(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [_concordance(frame["x"].to_numpy(), frame["y"].to_numpy(), frame["w"].to_numpy())]})

    def across(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [_concordance(frame["bx"].to_numpy(), frame["y"].to_numpy(), frame["w"].to_numpy())]})

    many = lambda key, value: cells.groupBy(key).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).where("_a < _b").select(key)
    own = cells.join(F.broadcast(many("bx", "x")), "bx").groupBy("bx").applyInPandas(inside, "s double")
    side = cells.join(F.broadcast(many("by", "y")), "by").groupBy("by").applyInPandas(across, "s double")
    grid = cells.groupBy("bx", "by").agg(F.sum("w").alias("n"))
    below = Window.partitionBy("bx").orderBy("by").rowsBetween(Window.unboundedPreceding, -1)
    xs, ys = grid.select("bx").distinct(), grid.select("by").distinct()
    full = xs.join(ys).join(grid, ["bx", "by"], "left").withColumn("n", F.coalesce("n", F.lit(0.0)))  # buckets squared
    full = full.withColumns({"_low": F.coalesce(F.sum("n").over(below), F.lit(0.0)), "_r": F.sum("n").over(Window.partitionBy("bx"))})
    left = Window.partitionBy("by").orderBy("bx").rowsBetween(Window.unboundedPreceding, -1)
    far = full.select((F.col("n") * F.coalesce(F.sum(F.col("_low") - (F.col("_r") - F.col("_low") - F.col("n"))).over(left), F.lit(0.0))).alias("s"))
    total = own.union(side).union(far).agg(F.sum("s").alias("s")).join(cells.agg(F.sum("w").alias("n")))
    return total.select(F.col("n").cast("long").alias("n"), F.when(F.col("n") > 1, F.coalesce("s", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1) / 2)).alias("tau"))


def inequality(df: DataFrame, column: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Of values from 0: by, n, min, max, mean, std, variation, gini; pairs of a row with itself aren't in the Gini's mean difference.

    The mean difference comes from running sums over distinct values.
    """
    x, w = F.col(column).cast("double"), _w(weight)
    rows = df.where(x >= 0)
    cells = rows.groupBy(*by, x.alias("_x")).agg(F.sum(w).alias("_w"), F.sum(w * w).alias("_ww"), F.count("*").alias("_n"))
    cells = running(cells, "_x", {"_before": F.col("_w"), "_sum": F.col("_w") * F.col("_x")}, by, exclusive=True)
    total = F.sum("_w")
    mean = F.sum(F.col("_w") * F.col("_x")) / total
    gini = F.sum(F.col("_w") * (F.col("_x") * F.col("_before") - F.col("_sum")))
    got = cells.groupBy(*by).agg(F.sum("_n").alias("n"), F.min("_x").alias("min"), F.max("_x").alias("max"), mean.alias("mean"), gini.alias("_g"), ((total * total - F.sum("_ww")) / 2).alias("_pairs"), total.alias("_t"))
    spread = matches(cells, got.select(*by, "mean"), list(by)) if by else cells.join(F.broadcast(got.select("mean")))
    spread = spread.groupBy(*by).agg(F.sum(F.col("_w") * F.pow(F.col("_x") - F.col("mean"), F.lit(2.0))).alias("_ss"))
    got = matches(got, spread, list(by)) if by else got.join(F.broadcast(spread))
    std = F.when(F.col("_t") > 1, F.sqrt(F.col("_ss") / (F.col("_t") - 1))).otherwise(0.0)
    return got.withColumns({"std": std, "gini": F.when((F.col("_pairs") > 0) & (F.col("mean") > 0), F.col("_g") / (2 * F.col("_pairs") * F.col("mean")))}).withColumn("variation", F.when(F.col("mean") > 0, F.col("std") / F.col("mean"))).select(*by, "n", "min", "max", "mean", "std", "variation", "gini")


def segregation(df: DataFrame, group: str, classes: str, weight: str | None = None) -> DataFrame:
    """Two groups (group above 0, or 0) over classes: n_classes, total, total_0, total_1, dissimilarity, variance_ratio, gini."""
    w = _w(weight)
    cells = df.where((F.col(group) >= 0) & (F.col(classes) >= 0)).groupBy(classes).agg(F.sum(F.when(F.col(group) > 0, 0.0).otherwise(w)).alias("a"), F.sum(F.when(F.col(group) > 0, w).otherwise(0.0)).alias("b"))
    cells = once(cells.withColumn("size", F.col("a") + F.col("b")).withColumn("share", F.col("b") / F.col("size")))
    all_ = cells.agg(F.sum("a").alias("_ta"), F.sum("b").alias("_tb"), F.count("*").alias("_k"))
    by_share = running(cells.groupBy("share").agg(F.sum("size").alias("_t")), "share", {"_before": F.col("_t"), "_sum": F.col("_t") * F.col("share")}, exclusive=True)
    apart = by_share.agg(F.sum(F.col("_t") * (F.col("share") * F.col("_before") - F.col("_sum"))).alias("_apart"))
    whole = F.col("_ta") + F.col("_tb")
    p = F.col("_tb") / whole
    d, v = 0.5 * F.sum(F.abs(F.col("a") / F.col("_ta") - F.col("b") / F.col("_tb"))), F.sum(F.col("size") * F.pow(F.col("share") - p, F.lit(2.0)))
    one = cells.join(F.broadcast(all_)).groupBy("_ta", "_tb", "_k").agg(d.alias("dissimilarity"), v.alias("_v")).join(apart)
    return one.select(F.col("_k").alias("n_classes"), whole.alias("total"), F.col("_ta").alias("total_0"), F.col("_tb").alias("total_1"), "dissimilarity", (F.col("_v") / (whole * p * (1 - p))).alias("variance_ratio"), (F.col("_apart") / (whole * whole * p * (1 - p))).alias("gini"))


def independence(df: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """For each value of y the largest difference, over values of x, between their share given y and their share overall: y, delta."""
    cells = df.groupBy(x, y).agg(F.sum(_w(weight)).alias("n"))
    xs = cells.groupBy(x).agg(F.sum("n").alias("r")).join(F.broadcast(cells.agg(F.sum("n").alias("t")))).select(x, (F.col("r") / F.col("t")).alias("_fx"))
    ys = cells.groupBy(y).agg(F.sum("n").alias("c"))
    grid = xs.join(ys).join(cells, [x, y], "left")  # categories of x times those of y
    return grid.groupBy(y).agg(F.max(F.abs(F.coalesce("n", F.lit(0.0)) / F.col("c") - F.col("_fx"))).alias("delta"))


def principal_components(df: DataFrame, columns: Sequence[str], correlation: bool = False) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Eigenvalues (falling), eigenvectors as columns, and df with scores pc1, pc2 ...; the sums of products come from one aggregate.

    The sign of a vector makes its largest component positive.
    """
    df = df.dropna(subset=list(columns))
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns], F.count("*").alias("n")).first()
    centred = [(F.col(c) - stats[f"m_{c}"]) / ((stats[f"s_{c}"] or 1.0) if correlation else 1.0) for c in columns]
    values, vectors = np.linalg.eigh(gram(df, centred) / max(1, stats["n"] - 1))
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    scores = {f"pc{k + 1}": sum((c * float(v) for c, v in zip(centred, vectors[:, k])), F.lit(0.0)) for k in range(len(columns))}
    return values, vectors, df.withColumns(scores)


def age_period(df: DataFrame, birth: str, start: str, end: str, event: str, years: tuple[int, int], ages: tuple[int, int]) -> DataFrame:
    """Rates by age and year: age, year, risk (rows alive in it from start to end), events (event not 0, in the year of end), rate."""
    c = {n: F.col(v).cast("int") for n, v in (("b", birth), ("s", start), ("e", end), ("d", event))}
    year = F.explode(F.sequence(F.greatest(c["s"], F.lit(years[0])), F.least(c["e"], F.lit(years[1])))).alias("year")
    rows = df.where((F.greatest(c["s"], F.lit(years[0])) <= F.least(c["e"], F.lit(years[1])))).select(c["b"].alias("_b"), c["e"].alias("_e"), c["d"].alias("_d"), year)
    rows = rows.withColumn("age", F.col("year") - F.col("_b")).where(F.col("age").between(*ages))
    out = rows.groupBy("age", "year").agg(F.count("*").alias("risk"), F.count_if((F.col("_d") != 0) & (F.col("year") == F.col("_e"))).alias("events"))
    return out.withColumn("rate", F.col("events") / F.col("risk"))


def histogram(df: DataFrame, x: str, points: Sequence[float], weight: str | None = None, left_closed: bool = True, scale: float = 1.0) -> DataFrame:
    """Heights of a histogram: low, high, n, height (scale times the share by width)."""
    cells = binned(df, x, points, weight=weight, left_closed=left_closed)
    cells = cells.join(F.broadcast(cells.agg(F.sum("weighted").alias("_t"))))
    return cells.select("low", "high", "n", F.when(F.col("_t") > 0, scale * F.col("weighted") / (F.col("_t") * (F.col("high") - F.col("low")))).alias("height"))


#: Kernels of u in [-1, 1] by name.
KERNELS = {
    "uniform": lambda u: F.lit(0.5),
    "triangle": lambda u: 1 - F.abs(u),
    "quartic": lambda u: 15 / 16 * F.pow(1 - u * u, F.lit(2.0)),
    "epanechnikov": lambda u: 0.75 * (1 - u * u),
}


def _near(df: DataFrame, x: str, points: Sequence[float], width: float) -> DataFrame:
    """A row for each point within width of a row's x: points are a parameter, and only those near are made."""
    at = F.filter(F.array(*[F.lit(float(p)) for p in points]), lambda p: F.abs(F.col(x) - p) <= width)
    return df.where(F.col(x).isNotNull()).withColumn("at", F.explode(at)).withColumn("_u", (F.col(x) - F.col("at")) / width)


def density(df: DataFrame, x: str, points: Sequence[float], width: float, kernel: str = "quartic", weight: str | None = None) -> DataFrame:
    """Kernel density at points: at, density (0 where no row is near)."""
    w = _w(weight)
    total = df.where(F.col(x).isNotNull()).agg(F.sum(w).alias("_t"))
    got = _near(df, x, points, width).groupBy("at").agg(F.sum(w * KERNELS[kernel](F.col("_u"))).alias("_s"))
    base = df.sparkSession.createDataFrame([(float(p),) for p in points], "at double")
    return base.join(got, "at", "left").join(F.broadcast(total)).select("at", F.coalesce(F.col("_s") / (F.col("_t") * width), F.lit(0.0)).alias("density"))


def smoothed_mean(df: DataFrame, x: str, y: str, points: Sequence[float], width: float, kernel: str = "quartic") -> DataFrame:
    """Kernel regression at points: at, n, mean (null where no row has weight)."""
    k = KERNELS[kernel](F.col("_u"))
    got = _near(df.where(F.col(y).isNotNull()), x, points, width).groupBy("at").agg(F.count("*").alias("n"), F.sum(k).alias("_k"), F.sum(k * F.col(y)).alias("_ky"))
    return got.select("at", "n", F.when(F.col("_k") > 0, F.col("_ky") / F.col("_k")).alias("mean"))


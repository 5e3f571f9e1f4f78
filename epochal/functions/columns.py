"""Functions of a whole ordered column: totals, running values, ranks, runs of equal values, and blocks.

order names a column that is unique within by and gives the order of rows. Runs are stretches of
consecutive equal values, not groups. Without by, no task sees all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import settled
from ..plans.ordered import attached, matches, neighbours, once, positions, running
from .scalar import EPS1

# totals over all rows


def totals(df: DataFrame, x: str) -> DataFrame:
    """df with <x>_sum, _mean, _std (0 for one row), _min and _max over all rows."""
    c = F.col(x).cast("double")
    return attached(df, **{f"{x}_sum": F.sum(c), f"{x}_mean": F.avg(c), f"{x}_std": F.coalesce(F.stddev_samp(c), F.lit(0.0)), f"{x}_min": F.min(c), f"{x}_max": F.max(c)})


def counted(df: DataFrame, x: str, y: str, name: str = "n") -> DataFrame:
    """df with <name>_eq, _ne, _lt, _gt, _le, _ge: how many rows have x so related to y."""
    a, b = F.col(x), F.col(y)
    cond = {"eq": a == b, "ne": a != b, "lt": a < b, "gt": a > b, "le": a <= b, "ge": a >= b}
    return attached(df, **{f"{name}_{k}": F.count_if(v) for k, v in cond.items()})


# order


def ahead(df: DataFrame, x: str, n: int, order: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """df with the value n rows ahead (behind for a negative n), 0 outside."""
    return neighbours(df, order, {name: (x, n)}, by).withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def cumulated(df: DataFrame, x: str, order: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    return running(df, order, {name: F.col(x)}, by)


def moving_average(df: DataFrame, x: str, n: int, order: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The mean of up to n rows on either side and the row itself, by differences of running sums."""
    df = once(running(df, order, {"_s": F.col(x).cast("double"), "_p": F.lit(1).cast("long")}, by))
    at = df.select(*by, F.col("_p").alias("_q"), F.col("_s").alias("_at"))
    top = df.groupBy(*by).agg(F.max("_p").alias("_n")) if by else df.agg(F.max("_p").alias("_n"))
    df = matches(df, top, list(by)) if by else df.join(F.broadcast(top))
    df = df.withColumns({"_hi": F.least(F.col("_p") + n, F.col("_n")), "_lo": F.greatest(F.col("_p") - n - 1, F.lit(0))})
    df = matches(df.withColumn("_q", F.col("_hi")), at.withColumnRenamed("_at", "_up"), [*by, "_q"])
    df = matches(df.withColumn("_q", F.col("_lo")), at.withColumnRenamed("_at", "_down"), [*by, "_q"], "left")
    value = (F.col("_up") - F.coalesce("_down", F.lit(0.0))) / (F.col("_hi") - F.col("_lo"))
    return df.withColumn(name, value).drop("_s", "_p", "_q", "_n", "_hi", "_lo", "_up", "_down")


def tail_mean(df: DataFrame, x: str, weight: str, order: str, name: str, by: Sequence[str] = (), from_start: bool = False) -> DataFrame:
    """The weighted mean of x from the row to the end (or from the start to the row); 0 where weights add up to 0."""
    df = running(df, order, {"_w": F.col(weight).cast("double"), "_wx": F.col(weight).cast("double") * F.col(x)}, by, descending=not from_start)
    return df.withColumn(name, F.when(F.col("_w") != 0, F.col("_wx") / F.col("_w")).otherwise(0.0)).drop("_w", "_wx")


def folded(df: DataFrame, step, start: Column, order: str, values: Sequence[str], name: str, by: Sequence[str]) -> DataFrame:
    """A value defined from the one before: step(previous, row) over the rows of each group in order.

    Groups are gathered into arrays, so by must part the rows into groups that fit in memory.
    """
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *values))).alias("_rows"))
    empty = F.array().cast(f"array<struct<{order}:{dict(df.dtypes)[order]},{name}:double>>")
    last = lambda acc: F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1)[name], start.cast("double"))
    out = F.aggregate("_rows", empty, lambda acc, r: F.concat(acc, F.array(F.struct(r[order].alias(order), step(last(acc), r).cast("double").alias(name)))))
    made = rows.select(*by, F.explode(out).alias("_x")).select(*by, F.col(f"_x.{order}").alias(order), F.col(f"_x.{name}").alias(name))
    return matches(df, made, [*by, order])


# ranks: by distinct values, of which each group's counts are summed up in order


def _values(df: DataFrame, x: str, by: Sequence[str]) -> DataFrame:
    cells = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("_n"))
    return running(cells, x, {"_upto": F.col("_n"), "_dense": F.lit(1).cast("long")}, by)


def ranks(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """df with <x>_rank (ties share the middle), <x>_dense, and <x>_cd: the share of rows up to the value."""
    cells = _values(df, x, by)
    n = df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.count("*").alias("_all"))
    cells = matches(cells, n, list(by)) if by else cells.join(F.broadcast(n))
    rank = F.col("_upto") - (F.col("_n") - 1) / 2
    cells = cells.select(*by, x, rank.alias(f"{x}_rank"), F.col("_dense").alias(f"{x}_dense"), (F.col("_upto") / F.col("_all")).alias(f"{x}_cd"))
    return matches(df, cells, [*by, x], "left")


def distinct_values(df: DataFrame, x: str, name: str, low: float | None = None, high: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """df with the number of distinct values of x (within [low, high]) in its group."""
    c = F.col(x)
    held = F.lit(True) if low is None else c >= low - EPS1
    held = held if high is None else held & (c <= high + EPS1)
    n = df.where(held).groupBy(*by, x).count().groupBy(*by).agg(F.count("*").alias(name))
    out = matches(df, n, list(by), "left") if by else df.join(F.broadcast(n))
    return out.withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def sorted_column(df: DataFrame, x: str, order: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """df with the values of x in ascending order, beside rows in their own order."""
    placed = positions(df.where(F.col(x).isNotNull()), order, "_p", by)
    cells = _values(df, x, by)
    values = cells.select(*by, F.col(x).alias(name), F.explode(F.sequence(F.col("_upto") - F.col("_n") + 1, F.col("_upto"))).alias("_p"))
    return matches(placed, values, [*by, "_p"]).drop("_p")


def quantile(df: DataFrame, x: str, share: float, by: Sequence[str] = ()) -> DataFrame:
    """by and the quantile at share * (n - 1), interpolated between order statistics."""
    cells = _values(df, x, by)
    n = df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.count("*").alias("_all"))
    cells = matches(cells, n, list(by)) if by else cells.join(F.broadcast(n))
    place = 1 + share * (F.col("_all") - 1)
    low = F.floor(place + 1e-9)
    at = lambda k: F.max(F.when((F.col("_upto") >= k) & (F.col("_upto") - F.col("_n") < k), F.col(x)))
    got = cells.groupBy(*by).agg(at(low).alias("_a"), at(F.least(low + 1, F.col("_all"))).alias("_b"), F.max(F.greatest(place - low, F.lit(0.0))).alias("_f"))
    return got.select(*by, ((1 - F.col("_f")) * F.col("_a") + F.col("_f") * F.col("_b")).alias("quantile"))


def absent(df: DataFrame, x: str, other: DataFrame, y: str, name: str = "absent") -> DataFrame:
    """df with 1 where the value of x is nowhere in y."""
    there = other.select(F.col(y).alias("_y")).where(F.col("_y").isNotNull()).distinct().withColumn("_hit", F.lit(1))
    return df.join(there, F.col(x) == F.col("_y"), "left").withColumn(name, F.when(F.col("_hit").isNull(), 1).otherwise(0)).drop("_y", "_hit")


# runs


def runs(df: DataFrame, x: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """df with change (1 on the first row of a run), run (number), run_size, run_place, run_first, run_last,
    and since: rows since the last change. Runs end with the groups of by."""
    if by:
        w = Window.partitionBy(*by).orderBy(order)
        df = df.withColumn("_p", F.row_number().over(w).cast("long")).withColumn("_before", F.lag(x).over(w))
    else:
        df = settled(positions(df, order, "_p"))
        df = df.join(df.select((F.col("_p") + 1).alias("_p"), F.col(x).alias("_before")), "_p", "left")
    df = df.withColumn("change", F.when((F.col("_p") == 1) | ~F.col("_before").eqNullSafe(F.col(x)), 1).otherwise(0)).drop("_before")
    if by:
        df = df.withColumn("run", F.sum("change").over(Window.partitionBy(*by).orderBy("_p")))
    else:
        df = running(df, "_p", {"run": F.col("change").cast("long")})
    df = once(df)
    size = df.groupBy(*by, "run").agg(F.count("*").alias("run_size"), F.min("_p").alias("_first"))
    df = matches(df, size, [*by, "run"]).withColumn("run_place", F.col("_p") - F.col("_first") + 1)
    flags = {"run_first": F.when(F.col("run_place") == 1, 1).otherwise(0), "run_last": F.when(F.col("run_place") == F.col("run_size"), 1).otherwise(0), "since": F.col("run_place") - 1}
    return df.withColumns(flags).drop("_p", "_first")


def run_statistics(df: DataFrame, x: str, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """One row for each run of x: first and last place in order, size, and of value the sum, mean, std (0 for one row), min, max and
    number of distinct values."""
    v = F.col(value).cast("double")
    return runs(df, x, order, by).groupBy(*by, "run", x).agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("size"), F.sum(v).alias("sum"), F.avg(v).alias("mean"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_distinct(v).alias("distinct"),
    )


# blocks


def blocks(df: DataFrame, keys: Sequence[str], order: str, value: str | None = None) -> DataFrame:
    """df with block (number of the group of keys in their order), block_size, block_place, block_first, block_last and,
    of value, block_min, block_max, block_positive (rows above 0) and block_share of them."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("block_size"), *([F.min(value).alias("block_min"), F.max(value).alias("block_max"), F.count_if(F.col(value) > EPS1).alias("block_positive")] if value else []))
    first, rest = keys[0], list(keys[1:])
    heads = running(groups.where(F.col(first).isNotNull()).groupBy(first).agg(F.count("*").alias("_k")), first, {"_before": F.col("_k")}, exclusive=True).drop("_k")
    within = F.row_number().over(Window.partitionBy(first).orderBy(*rest)) if rest else F.lit(1)
    groups = groups.join(heads, first).withColumn("block", F.col("_before") + within).drop("_before")
    if value:
        groups = groups.withColumn("block_share", F.col("block_positive") / F.col("block_size"))
    out = positions(matches(df, groups, list(keys)), order, "block_place", keys)
    return out.withColumns({"block_first": F.when(F.col("block_place") == 1, 1).otherwise(0), "block_last": F.when(F.col("block_place") == F.col("block_size"), 1).otherwise(0)})


def uniform_by(*keys: str, seed: int = 1) -> Column:
    """One uniform number for each value of keys, the same on every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / float(1 << 53)

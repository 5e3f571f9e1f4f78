"""Running sums, positions and neighbours over ordered rows of any number.

A window without a partition, or with one very large partition, runs in one task. Here the
order is cut into buckets of about equal rows; sums run inside the buckets, and the totals of
earlier buckets, a small table, are added. Only the cut points reach the driver.
"""

from __future__ import annotations

import contextlib
import io
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import settled

#: Buckets at most, and rows that need no second one; what the driver sees of the order is one number fewer. Where buckets would hold
#: more rows than ROWS, each is cut into as many again, and so on: the cuts of later levels stay in a table of one row for each bucket.
BUCKETS, LEAST, ROWS = 64, 20_000, 4_000_000


def number(df: DataFrame, name: str) -> Column:
    """The column as a double that keeps its order: times as seconds, dates as days."""
    kind = dict(df.dtypes)[name]
    if kind == "date":
        return F.datediff(F.col(name), F.lit("1970-01-01").cast("date")).cast("double")
    if kind.startswith("timestamp"):
        return F.col(name).cast("timestamp").cast("double")
    return F.col(name).cast("double")


def cuts(df: DataFrame, value: Column, buckets: int = BUCKETS) -> list[float]:
    """Upper ends of all buckets but the last."""
    shares = [i / buckets for i in range(1, buckets)]
    if not shares:
        return []
    return sorted(set(df.agg(F.percentile_approx(value, shares, 20 * buckets)).first()[0] or []))


def bucket_of(value: Column, ends: Sequence[float]) -> Column:
    """How many ends are below value, by halving."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value <= float(ends[mid]), between(low, mid)).otherwise(between(mid + 1, high))

    return between(0, len(ends))


def matches(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on names in which nulls equal nulls; the right's copies of names are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in names else c) for c in right.columns])
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"_r_{n}"))
    return left.join(renamed, on, how).drop(*[f"_r_{n}" for n in names])


def once(df: DataFrame) -> DataFrame:
    """df itself if its plan only reads and projects, else written and read again: what follows uses it several times."""
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        df.explain()
    return settled(df) if re.search(r"Exchange|Aggregate|Join|Window|Generate|Sort|Map|Python|Arrow|Pandas|Union", plan.getvalue()) else df


def bucketed(df: DataFrame, order: str, buckets: int) -> tuple[DataFrame, int]:
    """df with _bucket, which rises with the order; and how many buckets there are at most, as many as its rows need."""
    value, shares = number(df, order), [i / buckets for i in range(1, buckets)]
    one = df.agg(F.count("*").alias("n"), *([F.percentile_approx(value, shares, 20 * buckets).alias("ends")] if shares else [])).first()
    want = min(buckets, max(1, -(-one["n"] // LEAST)))
    ends = sorted({one["ends"][round(k * buckets / want) - 1] for k in range(1, want)}) if want > 1 and one["ends"] else []
    df = df.withColumn("_bucket", bucket_of(value, ends))
    found, rows = want, one["n"] / want
    while rows > ROWS and shares:
        ends = df.groupBy("_bucket").agg(F.array_distinct(F.percentile_approx(value, shares, 20 * buckets)).alias("_ends"))
        ends = settled(ends.withColumnRenamed("_bucket", "_of"))
        below = F.aggregate("_ends", F.lit(0), lambda n, x: n + F.when(x < value, 1).otherwise(0))
        df = df.join(ends, F.col("_bucket") == F.col("_of")).withColumn("_bucket", F.col("_bucket").cast("long") * buckets + below).drop("_of", "_ends")
        found, rows = found * buckets, rows / buckets
    return df, found


def running(df: DataFrame, order: str, sums: dict[str, Column | str], by: Sequence[str] = (), descending: bool = False, exclusive: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """df with a running sum for each name of sums, in the order of a column that is unique within by.

    exclusive leaves the row itself out. Rows of a null order are left out of the result.
    """
    by, df = list(by), once(df.where(F.col(order).isNotNull()))
    df, found = bucketed(df, order, buckets)
    turn = (lambda c: F.col(c).desc()) if descending else F.col
    inside = Window.partitionBy(*by, "_bucket").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    before = Window.partitionBy(*by).orderBy(turn("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    expr = {k: F.col(v) if isinstance(v, str) else v for k, v in sums.items()}
    if found == 1:
        return df.withColumns({k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in expr.items()}).drop("_bucket")
    totals = df.groupBy(*by, "_bucket").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in expr.items()])
    totals = totals.select(*by, "_bucket", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in expr])
    df = df.withColumns({f"_i_{k}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in expr.items()})
    out = df.join(F.broadcast(totals), "_bucket") if found <= BUCKETS and not by else matches(df, totals, [*by, "_bucket"])  # no more rows than buckets of one level
    return out.withColumns({k: F.col(f"_i_{k}") + F.col(f"_b_{k}") for k in expr}).drop("_bucket", *[f"_{s}_{k}" for s in "bi" for k in expr])


def sums_before(df: DataFrame, order: str, sums: dict[str, Column | str]) -> DataFrame:
    """df with the sum over the rows before for each name of sums, in the order of a column of any type whose values are unique.

    Rows are dealt by ranges that Spark samples; sums run inside a range, and the totals of ranges before, a row each, are added.
    """
    expr = {k: F.col(v) if isinstance(v, str) else v for k, v in sums.items()}
    placed = settled(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    along = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_range").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in expr.items()])
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(along), F.lit(0)).alias(f"_t_{k}") for k in expr])
    out = placed.withColumns({k: F.coalesce(F.sum(v).over(inside), F.lit(0)) for k, v in expr.items()}).join(F.broadcast(totals), "_range")  # as many rows as partitions
    return out.withColumns({k: F.col(k) + F.col(f"_t_{k}") for k in expr}).drop("_range", *[f"_t_{k}" for k in expr])


def positions(df: DataFrame, order: str, name: str = "position", by: Sequence[str] = ()) -> DataFrame:
    """df with the place of each row, from 1."""
    return running(df, order, {name: F.lit(1).cast("long")}, by)


def neighbours(df: DataFrame, order: str, values: dict[str, tuple[str, int]], by: Sequence[str] = ()) -> DataFrame:
    """df with values of other rows: name to (column, steps), steps ahead in the order, null outside.

    With by, groups are those of a window; without, rows meet by their positions in an equi-join.
    """
    if by:
        w = Window.partitionBy(*by).orderBy(order)
        return df.withColumns({k: F.lead(c, n).over(w) for k, (c, n) in values.items()})
    placed = settled(positions(df, order, "_place"))
    for k, (c, n) in values.items():
        other = placed.select((F.col("_place") - n).alias("_place"), F.col(c).alias(k))
        placed = placed.join(other, "_place", "left") if n else placed.withColumn(k, F.col(c))
    return placed.drop("_place")


def attached(df: DataFrame, **aggregates: Column) -> DataFrame:
    """df with aggregates over all its rows, which are one row and so broadcast."""
    return df.join(F.broadcast(df.agg(*[v.alias(k) for k, v in aggregates.items()])))

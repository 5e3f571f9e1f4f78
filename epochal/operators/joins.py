"""Joins of files of records: by key, by overlapping time, and between pairs of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a side without a record is filled with.
MISSING = -3


def looked_up(df: DataFrame, table: DataFrame, on: Sequence[str], missing: float = MISSING, last_by: str | None = None) -> DataFrame:
    """df with the other columns of table for equal keys, missing where there is none; of several rows with one key the last by last_by counts."""
    others = [c for c in table.columns if c not in on and c != last_by]
    if last_by:
        table = table.groupBy(*on).agg(*[F.max_by(c, last_by).alias(c) for c in others])
    out = df.join(table.select(*on, *others).withColumn("_hit", F.lit(True)), list(on), "left")
    fill = {c: F.when(F.col("_hit").isNull(), F.lit(missing).cast(t)).otherwise(F.col(c)) for c, t in table.dtypes if c in others and t not in ("string", "binary")}
    return out.withColumns(fill).drop("_hit")


def merged(main: DataFrame, files: Sequence[DataFrame], on: Sequence[str], missing: float = MISSING) -> DataFrame:
    """main with each of files looked up in turn."""
    for f in files:
        main = looked_up(main, f, on, missing)
    return main


def selected(df: DataFrame, keys: DataFrame, on: Sequence[str], once_by: str | None = None) -> DataFrame:
    """The rows whose key is among keys; with once_by at most one for each key, the first by it."""
    out = df.join(keys.select(*on).distinct(), list(on), "left_semi")
    if once_by is None:
        return out
    w = Window.partitionBy(*on).orderBy(once_by)
    return out.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def without_characters(df: DataFrame, column: str, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """Records of text without the characters in ranges (from 1, both ends in)."""
    parts, at = [], 1
    for a, b in sorted(ranges):
        if a > at:
            parts.append(F.substring(column, at, a - at))
        at = max(at, b + 1)
    return df.withColumn(column, F.concat(*parts, F.substring(F.col(column), F.lit(at), F.greatest(F.length(column) - at + 1, F.lit(0)))))


def sorted_records(df: DataFrame, column: str, keys: Sequence[tuple[int, int]]) -> DataFrame:
    """Records of text ordered by character ranges, byte by byte."""
    return df.orderBy(*[F.substring(column, a, b - a + 1).cast("binary") for a, b in keys])


def overlapped(a: DataFrame, b: DataFrame, id: str = "id", ts: str = "ts", tf: str = "tf", state: str = "state") -> DataFrame:
    """The full outer join of two files of dated records: id, records (in both), interval, level, ts, tf, state1, state2.

    The union of all starts and ends of an id cuts its time into elementary intervals; one row for each of them and each level holds the
    level-th record of either file that covers it (in the order of starts, ends and states), MISSING where there is none. Intervals that
    nothing covers are left out. A record meets only the elementary intervals that it covers.
    """
    both = a.select(F.col(id).alias("id"), F.col(ts).cast("double").alias("ts"), F.col(tf).cast("double").alias("tf"), F.col(state).cast("double").alias("state"), F.lit(1).alias("file"))
    both = both.unionByName(b.select(F.col(id).alias("id"), F.col(ts).cast("double").alias("ts"), F.col(tf).cast("double").alias("tf"), F.col(state).cast("double").alias("state"), F.lit(2).alias("file"))).where("ts < tf and id is not null")
    size = both.groupBy("id").agg(F.count("*").alias("records"))
    marks = both.select("id", F.explode(F.array("ts", "tf")).alias("t")).distinct()
    w = Window.partitionBy("id").orderBy("t")
    cuts = marks.select("id", F.col("t").alias("_a"), F.lead("t").over(w).alias("_b"), F.row_number().over(w).alias("_k"))
    at = lambda t, k: cuts.select("id", F.col("_a").alias(t), F.col("_k").alias(k))
    span = both.join(at("ts", "_first"), ["id", "ts"]).join(at("tf", "_end"), ["id", "tf"])
    span = span.select("id", "ts", "tf", "state", "file", F.explode(F.sequence(F.col("_first"), F.col("_end") - 1)).alias("_k")).join(cuts, ["id", "_k"])
    level = F.row_number().over(Window.partitionBy("id", "_k", "file").orderBy("ts", "tf", "state"))
    span = span.withColumn("level", level)
    out = span.groupBy("id", "_k", "_a", "_b", "level").agg(F.max(F.when(F.col("file") == 1, F.col("state"))).alias("state1"), F.max(F.when(F.col("file") == 2, F.col("state"))).alias("state2"))
    number = F.dense_rank().over(Window.partitionBy("id").orderBy("_k"))
    return out.join(size, "id").select("id", "records", number.alias("interval"), "level", F.col("_a").alias("ts"), F.col("_b").alias("tf"), F.coalesce("state1", F.lit(float(MISSING))).alias("state1"), F.coalesce("state2", F.lit(float(MISSING))).alias("state2"))


def pairs(df: DataFrame, order: str, keep: Sequence[str]) -> DataFrame:
    """A row for every two rows of df, the earlier by order first: columns a_ and b_. Its size is the square of df's: meant for small tables or blocks."""
    left = df.select(F.col(order).alias(f"a_{order}"), *[F.col(c).alias(f"a_{c}") for c in keep])
    right = df.select(F.col(order).alias(f"b_{order}"), *[F.col(c).alias(f"b_{c}") for c in keep])
    return left.join(right, F.col(f"a_{order}") < F.col(f"b_{order}"))


def distance(a: Column, b: Column, kind: str = "euclid", weights: Sequence[float] | None = None) -> Column:
    """Between two arrays: euclid, city (sum of absolute differences), differing (count of unequal values), dissimilarity (half the sum of
    absolute differences of shares)."""
    w = F.array(*[F.lit(float(x)) for x in weights]) if weights else F.transform(a, lambda x: F.lit(1.0))
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)
    d = F.zip_with(a, b, lambda x, y: (x - y).cast("double"))
    if kind == "euclid":
        return F.sqrt(add(F.zip_with(d, w, lambda x, v: v * x * x)))
    if kind == "city":
        return add(F.zip_with(d, w, lambda x, v: v * F.abs(x)))
    if kind == "differing":
        return add(F.zip_with(d, w, lambda x, v: F.when(x != 0, v).otherwise(0.0)))
    if kind == "dissimilarity":
        ta, tb = add(F.transform(a, lambda x: x.cast("double"))), add(F.transform(b, lambda x: x.cast("double")))
        return 0.5 * add(F.zip_with(F.zip_with(a, b, lambda x, y: F.abs(x / ta - y / tb)), w, lambda x, v: v * x))
    raise ValueError(kind)


def distances(df: DataFrame, order: str, features: Sequence[str], kind: str = "euclid", weights: Sequence[float] | None = None) -> DataFrame:
    """a, b, distance for every two rows."""
    rows = df.select(order, F.array(*[F.col(c).cast("double") for c in features]).alias("_f"))
    return pairs(rows, order, ["_f"]).select(F.col(f"a_{order}").alias("a"), F.col(f"b_{order}").alias("b"), distance(F.col("a__f"), F.col("b__f"), kind, weights).alias("distance"))


def replicated(df: DataFrame, block: str, times: DataFrame, n: str) -> DataFrame:
    """Each block of rows as often as times (block, n) says; copy counts from 1."""
    return df.join(times.where(F.col(n) > 0).select(block, n), block).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).drop(n)


def picked(df: DataFrame, block: str, ident: str, choice: DataFrame) -> DataFrame:
    """From each block the rows whose ident is chosen for it."""
    return df.join(choice.select(block, ident), [block, ident], "left_semi")


def weights_to(df: DataFrame, weight: str, total: float | None = None) -> DataFrame:
    """The weight scaled to add up to total (None: the number of rows)."""
    one = df.agg(F.sum(weight).alias("_s"), F.count("*").alias("_n"))
    out = df.join(F.broadcast(one)).withColumn(weight, F.col(weight) * (F.col("_n").cast("double") if total is None else F.lit(float(total))) / F.col("_s"))
    return out.drop("_s", "_n")


def recode(df: DataFrame, column: str, value: Column, where: Column | None = None) -> DataFrame:
    """column overwritten by value in the selected rows."""
    return df.withColumn(column, value if where is None else F.when(where, value).otherwise(F.col(column)))


def dummies(df: DataFrame, columns: Sequence[str], most: int = 1000, products: bool = False) -> DataFrame:
    """df with a 0/1 column for each value of each of columns (or, with products, each combination of them). Over most values is an error."""
    found = df.select(*columns).dropna().distinct().orderBy(*columns).limit(most + 1).collect() if products else None
    out = {}
    if products:
        for r in found:
            hit = F.lit(True)
            for c in columns:
                hit = hit & (F.col(c) == r[c])
            out["_".join(f"{c}_{r[c]}" for c in columns)] = hit
    else:
        for c in columns:
            for r in df.select(c).dropna().distinct().orderBy(c).limit(most + 1).collect():
                out[f"{c}_{r[0]}"] = F.col(c) == r[0]
    if len(out) > most:
        raise ValueError(f"over {most} values")
    return df.withColumns({k: F.when(v, 1).otherwise(0) for k, v in out.items()})


def both_sided(a: DataFrame, b: DataFrame, on: Sequence[str], value: str, missing: float = -1.0) -> DataFrame:
    """The full outer join of two lists: on, value_1, value_2, missing where one lacks the key."""
    left, right = a.select(*on, F.col(value).alias(f"{value}_1")), b.select(*on, F.col(value).alias(f"{value}_2"))
    return left.join(right, list(on), "full_outer").withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(missing)) for c in (f"{value}_1", f"{value}_2")})


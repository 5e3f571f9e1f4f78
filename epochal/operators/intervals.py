"""Interval-valued data: columns lo and hi (lo <= hi), between which a value lies."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fitting import gram
from ..plans.iterate import discard, settled
from ..plans.ordered import neighbours, running


def mean_bounds(df: DataFrame, lo: str = "lo", hi: str = "hi", by: Sequence[str] = ()) -> DataFrame:
    """by, n, and the least and largest mean; by gives the bounds of conditional means."""
    return df.where(F.col(lo) <= F.col(hi)).groupBy(*by).agg(F.count("*").alias("n"), F.avg(lo).alias("mean_lo"), F.avg(hi).alias("mean_hi"))


def distribution_bounds(df: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """At every endpoint x: the least (all of hi <= x) and largest (lo <= x) value of the distribution function, and its mean with values spread evenly
    over their intervals.

    All three are running sums over distinct endpoints.
    """
    rows = df.where(F.col(lo) <= F.col(hi)).select(F.col(lo).cast("double").alias("a"), F.col(hi).cast("double").alias("b"))
    point = F.when(F.col("b") > F.col("a"), 0.0).otherwise(1.0)
    ends = rows.select(F.col("a").alias("x"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), point.alias("p"), F.lit(0).alias("k"))
    ends = ends.union(rows.select("b", F.lit(1.0), F.lit(0.0), F.lit(0.0), F.when(F.col("b") > F.col("a"), 1).otherwise(0)))
    at = ends.groupBy("x").agg(*[F.sum(c).alias(c) for c in ("low", "high", "p", "k")])
    at = running(at, "x", {f"_{c}": F.col(c) for c in ("low", "high", "p", "k")})
    return _mean(rows, at.join(F.broadcast(rows.agg(F.count("*").alias("n")))))


def _mean(rows: DataFrame, out: DataFrame) -> DataFrame:
    """The mean from open intervals' lines, summed up by starts and ends, and 1 for each that has ended."""
    wide = rows.where("b > a").withColumn("s", 1 / (F.col("b") - F.col("a")))
    marks = wide.select(F.col("a").alias("x"), F.col("s").alias("ds"), (F.col("s") * F.col("a")).alias("dc")).union(wide.select("b", -F.col("s"), -F.col("s") * F.col("a")))
    marks = marks.groupBy("x").agg(F.sum("ds").alias("ds"), F.sum("dc").alias("dc")).unionByName(out.select("x", F.lit(0.0).alias("ds"), F.lit(0.0).alias("dc"))).groupBy("x").agg(F.sum("ds").alias("ds"), F.sum("dc").alias("dc"))
    lines = running(marks, "x", {"_ds": F.col("ds"), "_dc": F.col("dc")}).select("x", "_ds", "_dc")
    value = F.col("_ds") * F.col("x") - F.col("_dc") + F.col("_k") + F.col("_p")
    return out.join(lines, "x").select("x", (F.col("_low") / F.col("n")).alias("lower"), (F.col("_high") / F.col("n")).alias("upper"), (value / F.col("n")).alias("mean"))


def self_consistent(df: DataFrame, lo: str = "lo", hi: str = "hi", rounds: int = 500, eps: float = 1e-7) -> DataFrame:
    """The distribution over whole numbers that is the mean of what each row's set gives under it: value, share. Rows are counted by distinct
    intervals; mass is spread over an interval in proportion to the shares, by differences of running sums."""
    rows = df.where(F.col(lo) <= F.col(hi)).groupBy(F.col(lo).cast("long").alias("a"), F.col(hi).cast("long").alias("b")).agg(F.count("*").cast("double").alias("w"))
    rows = settled(rows)
    total = rows.agg(F.sum("w")).first()[0]
    if not total:
        return df.sparkSession.createDataFrame([], "value long, share double")
    spread = rows.select("w", F.explode(F.sequence("a", "b")).alias("value"), (F.col("b") - F.col("a") + 1).alias("k"))
    last = p = settled(spread.groupBy("value").agg((F.sum(F.col("w") / F.col("k")) / total).alias("share")))
    for _ in range(rounds):
        c = settled(running(p, "value", {"_c": F.col("share")}))
        upto = c.select(F.col("value").alias("b"), F.col("_c").alias("_up"))
        before = c.select(F.col("value").alias("a"), (F.col("_c") - F.col("share")).alias("_down"))
        mass = rows.join(upto, "b").join(before, "a").withColumn("_r", F.col("w") / (F.col("_up") - F.col("_down")))
        marks = mass.select(F.col("a").alias("value"), F.col("_r").alias("d")).union(mass.select(F.col("b") + 1, -F.col("_r"))).groupBy("value").agg(F.sum("d").alias("d"))
        marks = marks.unionByName(p.select("value", F.lit(0.0).alias("d"))).groupBy("value").agg(F.sum("d").alias("d"))
        factor = running(marks, "value", {"_f": F.col("d")}).select("value", "_f")
        new = settled(p.join(factor, "value").select("value", (F.col("share") * F.col("_f") / total).alias("new"), "share"), last)
        discard(c)
        last = new
        moved = new.agg(F.max(F.abs(F.col("new") - F.col("share")))).first()[0]
        p = new.select("value", F.col("new").alias("share"))
        if moved <= eps:
            break
    return p


def set_distribution(df: DataFrame, sets: str, rounds: int = 500, eps: float = 1e-7) -> DataFrame:
    """As self_consistent() for rows that hold an array of possible values: value, share. Equal sets are counted once."""
    rows = settled(df.where(F.size(sets) > 0).select(F.array_sort(F.array_distinct(sets)).alias("s")).groupBy("s").agg(F.count("*").cast("double").alias("w")).withColumn("k", F.xxhash64("s")))
    total = rows.agg(F.sum("w")).first()[0]
    each = settled(rows.select("k", "w", F.size("s").alias("n"), F.explode("s").alias("value")))
    last = p = settled(each.groupBy("value").agg((F.sum(F.col("w") / F.col("n")) / total).alias("share")))
    for _ in range(rounds):
        held = each.join(p, "value")
        whole = held.groupBy("k").agg(F.sum("share").alias("_t"))
        new = settled(held.join(whole, "k").groupBy("value").agg((F.sum(F.col("w") * F.col("share") / F.col("_t")) / total).alias("new"), F.first("share").alias("share")), last)
        last = new
        moved = new.agg(F.max(F.abs(F.col("new") - F.col("share")))).first()[0]
        p = new.select("value", F.col("new").alias("share"))
        if moved <= eps:
            break
    return p


def least_squares_bounds(df: DataFrame, lo: str, hi: str, columns: Sequence[str]) -> DataFrame:
    """term, lower, upper: the range of each coefficient when the dependent value is anywhere in its interval. Coefficients are linear in it, so the ends follow
    from the signs of the rows' weights: one aggregate for the products, one for the bounds."""
    df = df.dropna(subset=[lo, hi, *columns])
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    inverse = np.linalg.pinv(gram(df, x))
    aggs = []
    for k in range(len(x)):
        w = sum((c * float(v) for c, v in zip(x, inverse[k])), F.lit(0.0))
        aggs += [F.sum(w * F.when(w > 0, F.col(lo)).otherwise(F.col(hi))).alias(f"l{k}"), F.sum(w * F.when(w > 0, F.col(hi)).otherwise(F.col(lo))).alias(f"u{k}")]
    names = ["constant", *columns]
    return df.agg(*aggs).select(F.explode(F.array(*[F.struct(F.lit(n).alias("term"), F.col(f"l{k}").alias("lower"), F.col(f"u{k}").alias("upper")) for k, n in enumerate(names)])).alias("_x")).select("_x.*")


def next_intervals(df: DataFrame, order: str, time: str, by: Sequence[str] = ()) -> DataFrame:
    """df with lo and hi: its own time and that of the next row; the last row of a group is left out."""
    return neighbours(df, order, {"hi": (time, 1)}, by).where(F.col("hi").isNotNull()).withColumn("lo", F.col(time))


def averaged_ends(df: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """lo, hi and the mean of all lower (upper) ends that fall in [lo, hi]: by running sums over distinct ends, looked up at both ends."""
    rows = df.where(F.col(lo) <= F.col(hi)).select(F.col(lo).cast("double").alias("a"), F.col(hi).cast("double").alias("b")).distinct()
    out = rows
    for name, c in (("mean_lo", lo), ("mean_hi", hi)):
        vals = df.where(F.col(lo) <= F.col(hi)).groupBy(F.col(c).cast("double").alias("x")).agg(F.count("*").cast("double").alias("n"))
        marks = vals.unionByName(rows.select(F.col("a").alias("x"), F.lit(0.0).alias("n"))).unionByName(rows.select(F.col("b").alias("x"), F.lit(0.0).alias("n"))).groupBy("x").agg(F.sum("n").alias("n"))
        c_ = settled(running(marks, "x", {"_n": F.col("n"), "_s": F.col("n") * F.col("x")}))
        up = c_.select(F.col("x").alias("b"), F.col("_n").alias("_un"), F.col("_s").alias("_us"))
        down = c_.select(F.col("x").alias("a"), (F.col("_n") - F.col("n")).alias("_dn"), (F.col("_s") - F.col("n") * F.col("x")).alias("_ds"))
        out = out.join(up, "b").join(down, "a").withColumn(name, F.when(F.col("_un") > F.col("_dn"), (F.col("_us") - F.col("_ds")) / (F.col("_un") - F.col("_dn")))).drop("_un", "_us", "_dn", "_ds")
    return out.withColumnsRenamed({"a": "lo", "b": "hi"})


def variance_bounds(df: DataFrame, lo: str = "lo", hi: str = "hi", rounds: int = 50) -> DataFrame:
    """One row: n, mean_lo, mean_hi, the variances (by n) of all lower and of all upper ends, the least variance, the mean at it, and the most.

    The least is that of values as near to one mean as their intervals let them: the mean where the sum of what they lack changes its
    sign, found by running sums over distinct ends. For the most, values go to the end away from the mean: an interval whose middle is
    outside the range of the mean has its end fixed, which narrows the range, an aggregate a round. Where intervals stay open the
    most is null; largest_variance has it or bounds of it then.
    """
    spark = df.sparkSession
    rows = df.where(F.col(lo) <= F.col(hi)).select(F.col(lo).cast("double").alias("a"), F.col(hi).cast("double").alias("b"))
    one = rows.agg(F.count("*").alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"), F.sum("a").alias("sa")).first()
    shape = "n long, mean_lo double, mean_hi double, variance_lo double, variance_hi double, variance_least double, mean_least double, variance_most double"
    if not one.n:
        return spark.createDataFrame([], shape)
    ends = rows.select(F.col("a").alias("x"), F.lit(1).alias("na"), F.lit(0).alias("nb")).union(rows.select("b", F.lit(0), F.lit(1))).groupBy("x").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    at = running(ends, "x", {"_na": F.col("na"), "_sa": F.col("na") * F.col("x"), "_nb": F.col("nb"), "_sb": F.col("nb") * F.col("x")})
    fixed, held = F.col("_nb") + one.n - F.col("_na"), F.col("_sb") + one.sa - F.col("_sa")  # upper ends up to x, lower ends above it
    best = at.where(F.col("x") * fixed - held <= 1e-12 * (1 + F.abs(held))).agg(F.max(F.struct("x", fixed.alias("n"), held.alias("s"))).alias("m")).first().m
    mean = best.s / best.n if best.n else best.x
    off = F.greatest(F.col("a") - mean, mean - F.col("b"), F.lit(0.0))
    least = rows.agg(F.avg(off * off)).first()[0]
    low, high, most = one.ma, one.mb, None
    for _ in range(rounds):
        middle = (F.col("a") + F.col("b")) / 2
        down, up = middle <= low, middle >= high
        first, last = F.when(up & ~down, F.col("b")).otherwise(F.col("a")), F.when(down, F.col("a")).otherwise(F.col("b"))
        got = rows.agg(F.avg(first).alias("low"), F.avg(last).alias("high"), F.count_if(~down & ~up).alias("open"), F.var_pop(first).alias("v")).first()
        if not got.open:
            most = got.v
            break
        if (got.low, got.high) == (low, high):
            break
        low, high = got.low, got.high
    return spark.createDataFrame([(one.n, one.ma, one.mb, one.va, one.vb, least, mean, most)], shape)


#: Choices of open ends that are tried one by one.
CHOICES = 2**18


def largest_variance(df: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """One row: n, the largest variance (by n) that is found of values in their intervals, a bound that none exceeds, and whether both are one (exact).

    Values are at ends: with F(c) the mean square distance from c of the ends that are further from c, no variance is above the least F. F's least is
    at a mean of such ends, and then is a variance, or at a middle c, about which ends are open. Both come from running sums over distinct
    middles. The mean of the best values is within root(sum of squared widths) / n of c, so that an interval whose middle is farther off by its width / 2 n has
    its end fixed; where the open ones leave up to CHOICES choices, or are equal to each other, the best is told. Else both are given as they are.
    """
    spark, shape = df.sparkSession, "n long, largest double, at_most double, exact boolean"
    rows = df.where(F.col(lo) <= F.col(hi)).select(F.col(lo).cast("double").alias("a"), F.col(hi).cast("double").alias("b"))
    one = rows.agg(F.count("*").alias("n"), F.avg((F.col("a") + F.col("b")) / 2).alias("at"), F.sum((F.col("b") - F.col("a")) * (F.col("b") - F.col("a"))).alias("w2")).first()
    if not one.n:
        return spark.createDataFrame([], shape)
    n, r = one.n, float(np.sqrt(one.w2)) / one.n
    cells = settled(rows.select((F.col("a") - one.at).alias("a"), (F.col("b") - one.at).alias("b")).groupBy("a", "b").agg(F.count("*").alias("c")))  # about 0: squares keep their digits
    c, square = F.col("c"), lambda x: F.col(x) * F.col(x)
    middle = (F.col("a") + F.col("b")) / 2
    all_ = cells.agg(F.sum(c * F.col("b")).alias("b"), F.sum(c * square("b")).alias("b2"), F.min(middle).alias("first")).first()
    steps = cells.groupBy(middle.alias("m")).agg(F.sum(c * (F.col("a") - F.col("b"))).alias("d"), F.sum(c * (square("a") - square("b"))).alias("d2"))
    steps = running(settled(steps), "m", {"s": F.col("d"), "q": F.col("d2")})  # what changes when all up to m are at their lower ends
    mean, mean2 = (all_.b + F.col("s")) / n, (all_.b2 + F.col("q")) / n
    # from m on to the next middle F is mean2 - 2 c mean + c^2
    steps = neighbours(steps.select("m", mean.alias("u"), mean2.alias("u2")), "m", {"to": ("m", 1)})
    at = F.greatest("m", F.least("u", F.coalesce("to", "u")))
    least = steps.select((F.col("u2") - 2 * at * F.col("u") + at * at).alias("f"), at.alias("c"), (F.col("u2") - F.col("u") * F.col("u")).alias("v"))
    got = least.agg(F.min(F.struct("f", "c")).alias("low"), F.max("v").alias("v")).first()
    start = min(all_.first, all_.b / n)  # before the first middle
    bound, near, best = min((got.low.f, got.low.c), (all_.b2 / n - 2 * start * all_.b / n + start * start, start)) + (max(got.v, all_.b2 / n - (all_.b / n) ** 2),)
    exact = bound - best <= 1e-12 * (1 + abs(bound))
    if not exact:
        far = F.abs(middle - near) > r + (F.col("b") - F.col("a")) / (2 * n) + 1e-12
        fixed = F.when(far, F.when(middle > near, F.col("b")).otherwise(F.col("a")))
        held = cells.agg(F.coalesce(F.sum(c * fixed), F.lit(0.0)).alias("s"), F.coalesce(F.sum(c * fixed * fixed), F.lit(0.0)).alias("q")).first()
        ends = cells.where(~far).limit(int(np.log2(CHOICES)) + 1).collect()  # more than these are too many in any case
        if np.prod([float(e.c + 1) for e in ends]) <= CHOICES:
            s, q = np.array([held.s]), np.array([held.q])
            for e in ends:
                k = np.arange(e.c + 1)  # so many at the lower end
                s = (s[:, None] + k * e.a + (e.c - k) * e.b).ravel()
                q = (q[:, None] + k * e.a**2 + (e.c - k) * e.b**2).ravel()
            best = bound = max(best, float((q / n - (s / n) ** 2).max()))
            exact = True
        elif len(ends) == 1:  # equal intervals: the variance is concave in the number at the lower end
            (e,) = ends
            top = (e.a + e.b) * n / (2 * (e.a - e.b)) - (held.s + e.c * e.b) / (e.a - e.b)
            k = np.clip(np.array([np.floor(top), np.ceil(top)]), 0, e.c)
            s, q = held.s + k * e.a + (e.c - k) * e.b, held.q + k * e.a**2 + (e.c - k) * e.b**2
            best = bound = max(best, float((q / n - (s / n) ** 2).max()))
            exact = True
    discard(cells)
    return spark.createDataFrame([(n, float(best), float(max(bound, best)), bool(exact))], shape)


def means_above(df: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """x and mean: for each distinct lower end the mean of what lies above it, values being spread evenly over their intervals; null
    where nothing does. Sums from the far end over the lines of the mean distribution."""
    rows = df.where(F.col(lo) <= F.col(hi))
    points = rows.where(F.col(lo) == F.col(hi)).groupBy(F.col(lo).cast("double").alias("x")).agg(F.count("*").alias("_p"))  # known values are steps
    d = distribution_bounds(df, lo, hi).select("x", F.col("mean").alias("f")).join(points, "x", "left").join(F.broadcast(rows.agg(F.count("*").alias("_n"))))
    d = settled(d.select("x", "f", (F.coalesce("_p", F.lit(0)) / F.col("_n")).alias("j")))
    d = neighbours(d, "x", {"_x": ("x", 1), "_f": ("f", 1), "_j": ("j", 1)})
    part = F.coalesce((F.col("_f") - F.col("_j") - F.col("f")) * (F.col("_x") + F.col("x")) / 2 + F.col("_j") * F.col("_x"), F.lit(0.0))
    above = running(d.select("x", "f", part.alias("p")), "x", {"_s": F.col("p")}, descending=True)
    lower = rows.select(F.col(lo).cast("double").alias("x")).distinct()
    return lower.join(above, "x").select("x", F.when(1 - F.col("f") > 1e-12, F.col("_s") / (1 - F.col("f"))).alias("mean"))

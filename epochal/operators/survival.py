"""Survivor functions and life tables from episodes.

Rows are first counted by distinct times; risk sets are running sums over those times.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import np_chi2
from ..plans.ordered import matches, running


def _marks(episodes: DataFrame, by: Sequence[str], event: Column, weight: Column, extra: Sequence[Column] = ()) -> DataFrame:
    """Per group and time: events, ended (all who leave at it) and started (all who come under risk at it)."""
    ends = episodes.select(*by, F.col("tf").alias("time"), F.when(event, weight).otherwise(0.0).alias("events"), weight.alias("ended"), F.lit(0.0).alias("started"))
    starts = episodes.select(*by, F.col("ts").alias("time"), F.lit(0.0).alias("events"), F.lit(0.0).alias("ended"), weight.alias("started"))
    return ends.unionByName(starts).groupBy(*by, "time").agg(F.sum("events").alias("events"), F.sum("ended").alias("ended"), F.sum("started").alias("started"))


def product_limit(episodes: DataFrame, by: Sequence[str] = (), des: int | None = None, weight: str | None = None) -> DataFrame:
    """Product-limit estimates at event times: by, time, events, censored (from the event time before on, up to this one), risk, survivor, se, cumulated_rate.

    Those at risk at t started before t and haven't ended before it. An event is an end in des (None: any state other than the origin); other ends
    censor. The survivor function stays 0 once all at risk have the event; its se is -1 then. Greenwood's formula gives se.
    """
    by, w = list(by), F.lit(1.0) if weight is None else F.col(weight).cast("double")
    event = F.col("des") != F.col("org") if des is None else (F.col("des") == des) & (F.col("des") != F.col("org"))
    marks = running(_marks(episodes, by, event, w), "time", {"_started": F.col("started"), "_ended": F.col("ended"), "_cens": F.col("ended") - F.col("events")}, by)
    own = F.col("ended") - F.col("events")
    marks = marks.withColumns({"risk": F.col("_started") - F.col("started") - F.col("_ended") + F.col("ended"), "_cens": F.col("_cens") - own})
    at = marks.where(F.col("events") > 0)
    q = F.col("events") / F.col("risk")
    all_gone = F.col("events") >= F.col("risk") - 1e-12
    at = running(at, "time", {
        "_log": F.when(all_gone, 0.0).otherwise(F.log(1 - q)), "_zero": F.when(all_gone, 1).otherwise(0),
        "_green": F.when(all_gone, 0.0).otherwise(F.col("events") / (F.col("risk") * (F.col("risk") - F.col("events")))), "_order": F.lit(1).cast("long"),
    }, by)
    survivor = F.when(F.col("_zero") > 0, 0.0).otherwise(F.exp("_log"))
    prior = at.select(*by, (F.col("_order") + 1).alias("_order"), F.col("_cens").alias("_prior"))
    at = matches(at, prior, [*by, "_order"], "left")
    return at.select(*by, "time", "events", (F.col("_cens") - F.coalesce("_prior", F.lit(0.0))).alias("censored"), "risk", survivor.alias("survivor"), F.when(F.col("_zero") > 0, -1.0).otherwise(survivor * F.sqrt("_green")).alias("se"), F.when(F.col("_zero") == 0, -F.col("_log")).alias("cumulated_rate"))


def survivor_times(estimates: DataFrame, shares: Sequence[float] = (0.5,), by: Sequence[str] = ()) -> DataFrame:
    """by, share, time: where the survivor function falls to 1 - share, interpolated between event times (from 1 at 0); null if it doesn't."""
    by = list(by)
    places = running(estimates, "time", {"_k": F.lit(1).cast("long")}, by)
    before = places.select(*by, (F.col("_k") + 1).alias("_k"), F.col("time").alias("_t0"), F.col("survivor").alias("_s0"))
    rows = matches(places, before, [*by, "_k"], "left").withColumns({"_t0": F.coalesce("_t0", F.lit(0.0)), "_s0": F.coalesce("_s0", F.lit(1.0))})
    rows = rows.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    level = 1 - F.col("share")
    hit = (F.col("survivor") <= level) & (F.col("_s0") > level)
    when = F.col("_t0") + (F.col("_s0") - level) / (F.col("_s0") - F.col("survivor")) * (F.col("time") - F.col("_t0"))
    return rows.groupBy(*by, "share").agg(F.min(F.when(hit, when)).alias("time"))


def compare(episodes: DataFrame, group: str, des: int | None = None, weight: str | None = None) -> DataFrame:
    """Tests of equal survivor functions: test, statistic, df, cdf (of chi square at the statistic).

    log-rank, and with weights at each event time: Breslow (those at risk), Tarone-Ware (their root), Prentice (a survivor estimate).
    Groups become columns of the table of times (a few groups are meant); observed less expected and their covariances are sums
    over that table, and the driver solves as many equations as there are groups less one.
    """
    spark = episodes.sparkSession
    levels = [r[0] for r in episodes.where(F.col(group).isNotNull()).select(group).distinct().orderBy(group).limit(101).collect()]
    if len(levels) > 100:
        raise ValueError("over 100 groups to compare")
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    event = F.col("des") != F.col("org") if des is None else (F.col("des") == des) & (F.col("des") != F.col("org"))
    marks = _marks(episodes.where(F.col(group).isNotNull()), [group], event, w)
    wide = marks.groupBy("time").agg(*[F.sum(F.when(F.col(group) == v, F.col(c)).otherwise(0.0)).alias(f"{c}{k}") for k, v in enumerate(levels) for c in ("events", "ended", "started")])
    ks = range(len(levels))
    wide = running(wide, "time", {f"_at{k}": F.col(f"started{k}") - F.col(f"ended{k}") for k in ks}, exclusive=True)
    n, d = sum((F.col(f"_at{k}") for k in ks), F.lit(0.0)), sum((F.col(f"events{k}") for k in ks), F.lit(0.0))
    wide = wide.withColumns({"_n": n, "_d": d}).where((F.col("_d") > 0) & (F.col("_n") > 0))
    wide = running(wide, "time", {"_s": F.log(1 - F.col("_d") / (F.col("_n") + 1))})
    weights = {"log-rank": F.lit(1.0), "Breslow": F.col("_n"), "Tarone-Ware": F.sqrt("_n"), "Prentice": F.exp("_s")}
    aggs, spread = [], F.when(F.col("_n") > 1, F.col("_d") * (F.col("_n") - F.col("_d")) / (F.col("_n") * F.col("_n") * (F.col("_n") - 1))).otherwise(0.0)
    for t, v in enumerate(weights.values()):
        for i in ks:
            aggs.append(F.sum(v * (F.col(f"events{i}") - F.col(f"_at{i}") * F.col("_d") / F.col("_n"))).alias(f"u{t}_{i}"))
            aggs += [F.sum(v * v * F.col(f"_at{i}") * ((F.col("_n") if i == j else F.lit(0.0)) - F.col(f"_at{j}")) * spread).alias(f"v{t}_{i}_{j}") for j in ks]
    row, g = wide.agg(*aggs).first(), len(levels) - 1
    out = []
    for t, name in enumerate(weights):
        if g < 1 or row["u0_0"] is None:
            break
        u = np.array([row[f"u{t}_{i}"] for i in range(g)])
        v = np.array([[row[f"v{t}_{i}_{j}"] for j in range(g)] for i in range(g)])
        stat = float(u @ np.linalg.pinv(v) @ u)
        out.append((name, stat, g, float(np_chi2(stat, g))))
    return spark.createDataFrame(out, "test string, statistic double, df int, cdf double")


def life_table(episodes: DataFrame, points: Sequence[float], by: Sequence[str] = (), cfrac: float = 0.5, des: int | None = None, weight: str | None = None) -> DataFrame:
    """Actuarial life table over intervals from each point to the next (the last is open): by, start, entering, censored, exposed,
    events, q, survivor (at the start), se, density, density_se, rate, rate_se.

    Exposed: entering less cfrac of those censored. Durations are tf - ts. Density and rate are null in the open interval.
    """
    by, p = list(by), [float(x) for x in points]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    event = F.col("des") != F.col("org") if des is None else (F.col("des") == des) & (F.col("des") != F.col("org"))
    length, k = F.col("tf") - F.col("ts"), F.lit(-1)
    for x in p:
        k = k + F.when(length >= x, 1).otherwise(0)
    rows = episodes.withColumn("_k", k).where("_k >= 0").groupBy(*by, "_k").agg(F.sum(F.when(event, w).otherwise(0.0)).alias("events"), F.sum(F.when(event, 0.0).otherwise(w)).alias("censored"))
    # a table of as many rows as points for each group: windows over it are small
    ladder = episodes.sparkSession.createDataFrame([(i, a, b - a if b is not None else None) for i, (a, b) in enumerate(zip(p, [*p[1:], None]))], "_k int, start double, width double")
    full = (rows.select(*by).distinct().join(F.broadcast(ladder)) if by else ladder)
    rows = matches(full, rows, [*by, "_k"], "left").withColumns({"events": F.coalesce("events", F.lit(0.0)), "censored": F.coalesce("censored", F.lit(0.0))})
    order = Window.partitionBy(*by).orderBy("_k")
    after, before = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("entering", F.sum(F.col("events") + F.col("censored")).over(after)).withColumn("exposed", F.col("entering") - cfrac * F.col("censored"))
    rows = rows.withColumn("q", F.when(F.col("exposed") > 0, F.col("events") / F.col("exposed")).otherwise(0.0))
    rows = rows.withColumns({"_log": F.coalesce(F.sum(F.when(F.col("q") < 1, F.log(1 - F.col("q")))).over(before), F.lit(0.0)), "_zero": F.coalesce(F.max(F.when(F.col("q") >= 1, 1).otherwise(0)).over(before), F.lit(0)), "_var": F.coalesce(F.sum(F.when(F.col("q") < 1, F.col("q") / ((1 - F.col("q")) * F.col("exposed")))).over(before), F.lit(0.0))})
    c = F.col
    rows = rows.withColumn("survivor", F.when(c("_zero") == 1, 0.0).otherwise(F.exp("_log")))
    rows = rows.withColumns({"se": c("survivor") * F.sqrt("_var"), "density": c("survivor") * c("q") / c("width"), "rate": F.when(c("q") < 2, 2 * c("q") / (c("width") * (2 - c("q"))))})
    density_se = F.when((c("q") > 0) & (c("exposed") > 0), c("density") * F.sqrt(c("_var") + (1 - c("q")) / (c("exposed") * c("q")))).otherwise(0.0)
    rate_se = F.when((c("q") > 0) & (c("exposed") > 0), c("rate") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.pow(c("rate") * c("width") / 2, F.lit(2.0))) / (c("q") * c("exposed")))).otherwise(0.0)
    return rows.select(*by, "start", "entering", "censored", "exposed", "events", "q", "survivor", "se", "density", density_se.alias("density_se"), "rate", rate_se.alias("rate_se"))


def discrete_product_limit(df: DataFrame, time: str, event: str, start: str | None = None, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """For whole times: by, time, risk, events, censored, rate, survivor (the product over times before), at times observed."""
    by, w = list(by), F.lit(1.0) if weight is None else F.col(weight).cast("double")
    t = F.col(time).cast("long")
    ends = df.select(*by, t.alias("time"), F.when(F.col(event) != 0, w).otherwise(0.0).alias("events"), F.when(F.col(event) != 0, 0.0).otherwise(w).alias("censored"), F.lit(0.0).alias("_in"))
    starts = df.select(*by, (F.col(start).cast("long") if start else F.lit(0).cast("long")).alias("time"), F.lit(0.0).alias("events"), F.lit(0.0).alias("censored"), w.alias("_in"))
    rows = ends.unionByName(starts).groupBy(*by, "time").agg(*[F.sum(c).alias(c) for c in ("events", "censored", "_in")])
    rows = running(rows, "time", {"_started": F.col("_in"), "_gone": F.col("events") + F.col("censored")}, by)
    rows = rows.withColumn("risk", F.col("_started") - F.col("_gone") + F.col("events") + F.col("censored")).where("events + censored > 0")
    rate = F.when(F.col("risk") > 0, F.col("events") / F.col("risk")).otherwise(0.0)
    rows = running(rows.withColumn("rate", rate), "time", {"_log": F.when(F.col("rate") < 1, F.log(1 - F.col("rate"))).otherwise(0.0), "_zero": F.when(F.col("rate") >= 1, 1).otherwise(0)}, by, exclusive=True)
    return rows.select(*by, "time", "risk", "events", "censored", "rate", F.when(F.col("_zero") > 0, 0.0).otherwise(F.exp("_log")).alias("survivor"))


def interval_product_limit(df: DataFrame, low: str, high: str, event: str) -> DataFrame:
    """As discrete_product_limit() where a time is known to be in [low, high]: its weight is spread evenly over the whole times in it."""
    lo, hi = F.col(low).cast("long"), F.col(high).cast("long")
    rows = df.where(lo <= hi).select(F.explode(F.sequence(lo, hi)).alias("time"), (1.0 / (hi - lo + 1)).alias("w"), F.col(event).alias("event"))
    return discrete_product_limit(rows, "time", "event", weight="w")


def discrete_life_table(df: DataFrame, age: str, death: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """By age reached: by, age, risk, deaths, censored, q, survivor, expectation (mean remaining whole ages from the survivor function, up to the last age)."""
    out = discrete_product_limit(df, age, death, by=by, weight=weight).withColumnsRenamed({"time": "age", "events": "deaths", "rate": "q"})
    out = running(out, "age", {"_rest": F.col("survivor") * (1 - F.col("q"))}, by, descending=True)
    return out.withColumn("expectation", F.when(F.col("survivor") > 0, F.col("_rest") / F.col("survivor"))).drop("_rest")

"""Transition-rate models of episodes. A row adds d ln r(tf) + ln S(tf) - ln S(ts) to the log-likelihood, d being 1 for an event.

With a = exp(x coef_A), b = exp(x coef_B), c = x coef_C (exp of it where said): see FAMILIES.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import _gamma_sides, np_log_gamma
from ..plans.fitting import Fit, by_predictors, maximise, summed
from ..plans.iterate import discard, settled
from ..plans.ordered import running
from .episodes import periods
from .regression import _log_normal_cdf, glm


def _event(des: int | None) -> Column:
    return F.when((F.col("des") != F.col("org")) & (F.lit(True) if des is None else F.col("des") == des), 1.0).otherwise(0.0)


def exponential(episodes: DataFrame, columns: Sequence[str] = (), des: int | None = None, weight: str | None = None) -> Fit:
    """r = a. Fitted as counts of events with the log of the duration as offset: aggregates of built-in functions only. loglik is the episodes' own."""
    rows = episodes.withColumns({"_d": _event(des), "_o": F.log(F.col("tf") - F.col("ts"))})
    fit, _ = glm(rows, "_d", list(columns), "poisson", offset="_o", weight=weight)
    w = F.lit(1.0) if weight is None else F.col(weight)
    eta = sum((F.lit(float(b)) * (F.lit(1.0) if n == "constant" else F.col(n)) for n, b in zip(fit.names, fit.coef)), F.lit(0.0))
    fit.loglik = float(rows.agg(F.sum(w * (F.col("_d") * eta - F.exp(eta) * (F.col("tf") - F.col("ts"))))).first()[0])
    return fit


def null_exponential(episodes: DataFrame, by: Sequence[str] = (), des: int | None = None) -> DataFrame:
    """The constant rate in closed form: by, events, exposure, rate, loglik."""
    got = episodes.groupBy(*by).agg(F.sum(_event(des)).alias("events"), F.sum(F.col("tf") - F.col("ts")).alias("exposure")) if by else episodes.agg(F.sum(_event(des)).alias("events"), F.sum(F.col("tf") - F.col("ts")).alias("exposure"))
    rate = F.col("events") / F.col("exposure")
    return got.withColumns({"rate": rate, "loglik": F.when(F.col("events") > 0, F.col("events") * F.log(rate) - F.col("events")).otherwise(0.0)})


def occurrence_rates(episodes: DataFrame, points: Sequence[float], by: Sequence[str] = (), des: int | None = None) -> DataFrame:
    """The piecewise constant model without covariates in closed form: by, period, start, events, exposure, rate."""
    rows = periods(episodes, points).where("period >= 0")
    starts = F.element_at(F.array(*[F.lit(float(p)) for p in points]), F.col("period") + 1)
    out = rows.groupBy(*by, "period").agg(F.sum(_event(des)).alias("events"), F.sum(F.col("tf") - F.col("ts")).alias("exposure"))
    return out.select(*by, "period", starts.alias("start"), "events", "exposure", (F.col("events") / F.col("exposure")).alias("rate"))


def piecewise(episodes: DataFrame, points: Sequence[float], columns: Sequence[str] = (), des: int | None = None, specific: bool = False) -> Fit:
    """Rates constant in periods, which hold their first moment: one constant for each period and, with specific, coefficients of its own too. points begin with 0.
    Terms are the first period's constant and the others' differences from it."""
    rows = periods(episodes, points)
    flags = {f"period_{k}": F.when(F.col("period") == k, 1.0).otherwise(0.0) for k in range(1, len(points))}
    rows, names = rows.withColumns(flags), [*flags, *columns]
    if specific:
        more = {f"{c}_{k}": F.when(F.col("period") == k, F.col(c)).otherwise(0.0) for k in range(1, len(points)) for c in columns}
        rows, names = rows.withColumns(more), [*names, *more]
    return _constant(rows.withColumns({"_d": _event(des), "_x": F.col("tf") - F.col("ts")}), names)


def _constant(rows: DataFrame, columns: Sequence[str]) -> Fit:
    """Constant rates exp(constant + x coef) of _d events in the exposure _x. Rows alike in columns are added up first; a row may have an event and no exposure."""
    cells = settled(rows.groupBy(*[F.col(c).cast("double").alias(c) for c in columns]).agg(F.sum("_d").alias("_d"), F.sum(F.col("_x").cast("double")).alias("_x")))
    p = 1 + len(columns)
    total = cells.agg(F.sum("_d"), F.sum("_x")).first()

    def sums(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def batch(f) -> np.ndarray:
            x = np.column_stack([np.ones(len(f)), *(f[c].to_numpy(float) for c in columns)])
            eta, d = x @ b, f["_d"].to_numpy(float)
            expected = np.exp(eta) * f["_x"].to_numpy(float)
            return np.concatenate([[d @ eta - expected.sum()], x.T @ (d - expected), ((x.T * expected) @ x).ravel()])

        s = summed(cells, 1 + p + p * p, batch)
        return float(s[0]), s[1 : 1 + p], s[1 + p :].reshape(p, p)

    start = [float(np.log(max(total[0] or 0, 0.5) / (total[1] or 1))), *([0.0] * len(columns))]
    fit = maximise(sums, start, ["constant", *columns])
    discard(cells)
    return fit


def _weibull(xa, xb, d, ts, tf):
    a, b = np.exp(xa), np.exp(xb)
    cum = lambda t: np.where(t > 0, np.exp(b * (np.log(np.where(t > 0, t, 1.0)) + xa)), 0.0)
    return d * (xb + b * xa + (b - 1) * np.log(tf)) - cum(tf) + cum(ts)


def _log_logistic(xa, xb, d, ts, tf):
    b = np.exp(xb)
    odds = lambda t: np.where(t > 0, np.exp(b * (np.log(np.where(t > 0, t, 1.0)) + xa)), 0.0)
    return d * (xb + b * xa + (b - 1) * np.log(tf) - np.log1p(odds(tf))) - np.log1p(odds(tf)) + np.log1p(odds(ts))


def _log_logistic2(xa, xb, xc, d, ts, tf):
    a, b, c = np.exp(xa), np.exp(xb), np.exp(xc)
    odds = lambda t: np.where(t > 0, np.exp(b * (np.log(np.where(t > 0, t, 1.0)) + xa)), 0.0)
    # S = (1 + (at)^b)^(-c / a)
    return d * (xc - xa + xb + b * xa + (b - 1) * np.log(tf) - np.log1p(odds(tf))) - c / a * (np.log1p(odds(tf)) - np.log1p(odds(ts)))


def _gompertz(xa, xb, xc, d, ts, tf):
    a, b = np.exp(xa), np.exp(xb)
    near = np.abs(np.real(xc)) < 1e-10
    safe = np.where(near, 1.0, xc)
    grown = np.where(near, tf - ts + xc * (tf * tf - ts * ts) / 2, (np.exp(safe * tf) - np.exp(safe * ts)) / safe)
    return d * np.log(a + b * np.exp(xc * tf)) - a * (tf - ts) - b * grown


def _gompertz2(xb, xc, d, ts, tf):
    return _gompertz(np.full_like(xb, -745.0), xb, xc, d, ts, tf)


def _sickle(xa, xb, d, ts, tf):
    a, b = np.exp(xa), np.exp(xb)
    cum = lambda t: a * b * (b - (t + b) * np.exp(-t / b))
    return d * (xa + np.log(tf) - tf / b) - cum(tf) + cum(ts)


def _log_normal(xa, xb, d, ts, tf):
    b = np.exp(xb)
    z = lambda t: (np.log(np.where(t > 0, t, 1.0)) - xa) / b
    survive = lambda t: np.where(t > 0, _log_normal_cdf(-z(t)), 0.0)
    zt = z(tf)
    density = -zt * zt / 2 - 0.5 * np.log(2 * np.pi) - xb - np.log(tf)
    return d * (density - survive(tf)) + survive(tf) - survive(ts)


def _log_normal_shifted(xa, xb, xc, d, ts, tf):
    c = np.exp(xc)
    inside = lambda t: np.real(t - c) > 0
    z = lambda t: (np.log(np.where(inside(t), t - c, 1.0)) - xa) / np.exp(xb)
    survive = lambda t: np.where(inside(t), _log_normal_cdf(-z(t)), 0.0)
    density = np.where(inside(tf), -z(tf) * z(tf) / 2 - 0.5 * np.log(2 * np.pi) - xb - np.log(np.where(inside(tf), tf - c, 1.0)), -np.inf)
    return np.where(d > 0, density - survive(tf), 0.0) * d + survive(tf) - survive(ts)


def _mixed(xa, xb, d, ts, tf):
    v = np.exp(xb)
    grown = lambda t: np.log1p(v * np.exp(xa) * t)
    return d * (xa - grown(tf)) - (grown(tf) - grown(ts)) / v


#: Logarithm of the rate, and the cumulative rate, of families that can be mixed.
_RATES = {
    "weibull": (lambda t, xa, xb: xb + np.exp(xb) * xa + (np.exp(xb) - 1) * np.log(t), lambda t, xa, xb: _power(t, xa, xb)),
    "log_logistic": (lambda t, xa, xb: xb + np.exp(xb) * xa + (np.exp(xb) - 1) * np.log(t) - np.log1p(_power(t, xa, xb)), lambda t, xa, xb: np.log1p(_power(t, xa, xb))),
    "sickle": (lambda t, xa, xb: xa + np.log(t) - t / np.exp(xb), lambda t, xa, xb: np.exp(xa + xb) * (np.exp(xb) - (t + np.exp(xb)) * np.exp(-t / np.exp(xb)))),
}


def _power(t, xa, xb):
    """(a t)^b, 0 at 0."""
    return np.where(t > 0, np.exp(np.exp(xb) * (np.log(np.where(t > 0, t, 1.0)) + xa)), 0.0)


def _mixture(family: str):
    """The family's rates multiplied by a gamma variable of mean 1 and variance exp(xc): S = (1 + variance H)^(-1 / variance)."""
    log_rate, whole = _RATES[family]

    def loglik(xa, xb, xc, d, ts, tf):
        v = np.exp(xc)
        grown = lambda t: np.log1p(v * whole(t, xa, xb))
        return d * (log_rate(tf, xa, xb) - grown(tf)) - (grown(tf) - grown(ts)) / v

    return loglik


def _inverse_gaussian(a, xb, d, ts, tf):
    b = np.exp(xb)

    def survive(t):
        root = np.sqrt(np.where(t > 0, t, 1.0))
        first = _log_normal_cdf(-(a * t - 1) / (b * root))
        second = 2 * a / (b * b) + _log_normal_cdf(-(a * t + 1) / (b * root))
        return np.where(t > 0, first + np.log1p(-np.exp(second - first)), 0.0)

    z = (a * tf - 1) / (b * np.sqrt(tf))
    density = -z * z / 2 - 0.5 * np.log(2 * np.pi) - xb - 1.5 * np.log(tf)
    return d * (density - survive(tf)) + survive(tf) - survive(ts)


def _generalised_gamma(k: float):
    root, log_gamma = np.sqrt(k), float(np_log_gamma(k))

    def loglik(xa, xb, d, ts, tf):
        b = np.exp(xb)

        def survive(t):
            q = np.where(t > 0, k * np.exp((np.log(np.where(t > 0, t, 1.0)) - xa) / (b * root)), 0.0)
            x = np.real(q)
            out = _gamma_sides(np.full(x.shape, k), x)[1]
            slope = np.where(x > 0, np.exp((k - 1) * np.log(np.where(x > 0, x, 1.0)) - x - log_gamma), 0.0)
            return np.log(out - 1j * np.imag(q) * slope) if np.iscomplexobj(q) else np.log(out)  # along the imaginary axis to first order

        z = (np.log(tf) - xa) / b
        density = (k - 0.5) * np.log(k) + root * z - k * np.exp(z / root) - log_gamma - xb - np.log(tf)
        return d * (density - survive(tf)) + survive(tf) - survive(ts)

    return loglik


#: Name: number of predictors, log-likelihood. The second parameter of log_normal is the log of the standard deviation.
FAMILIES = {
    "weibull_mixture": (3, _mixture("weibull")),
    "log_logistic_mixture": (3, _mixture("log_logistic")),
    "sickle_mixture": (3, _mixture("sickle")),
    "inverse_gaussian": (2, _inverse_gaussian),  # first passages of a Wiener process with drift xa (not its exponential) and standard deviation b over a distance of 1
    "generalised_gamma": (2, _generalised_gamma),  # S = Q(k, k exp((ln t - xa) / (b sqrt k))), k fixed
    "exponential_mixture": (2, _mixed),  # constant rates a, multiplied by a gamma variable of mean 1 and variance b
    "weibull": (2, _weibull),  # S = exp(-(a t)^b)
    "log_logistic": (2, _log_logistic),  # S = 1 / (1 + (a t)^b)
    "log_logistic_2": (3, _log_logistic2),  # S = (1 + (a t)^b)^(-c / a), c = exp
    "gompertz_makeham": (3, _gompertz),  # r = a + b exp(c t)
    "gompertz": (2, _gompertz2),  # r = b exp(c t)
    "sickle": (2, _sickle),  # r = a t exp(-t / b)
    "log_normal": (2, _log_normal),  # S = 1 - Phi((ln t - xa) / b)
    "log_normal_shifted": (3, _log_normal_shifted),  # S = 1 - Phi((ln(t - c) - xa) / b) from c = exp on; no event is before c
}


def _alike(episodes: DataFrame, des: int | None, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """ts, tf, _d and columns of episodes that are alike in them, once, with the sum of their weights: every step reads these."""
    kept = list(dict.fromkeys(columns))
    cells = episodes.select(F.col("ts").cast("double").alias("ts"), F.col("tf").cast("double").alias("tf"), _event(des).alias("_d"), *[F.col(c).cast("double").alias(c) for c in kept], (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("_w"))
    return cells.groupBy("ts", "tf", "_d", *kept).agg(F.sum("_w").alias("_w"))


def parametric(episodes: DataFrame, family: str, columns: Sequence[Sequence[str]] = ((), (), ()), des: int | None = None, weight: str | None = None, start: Sequence[float] | None = None, shape: float = 1.0) -> Fit:
    """A model of FAMILIES with covariates for each of its terms; shape is the k of generalised_gamma. Likelihood, gradient and information are summed in numpy over Arrow batches."""
    terms, f = FAMILIES[family]
    f = f(shape) if family == "generalised_gamma" else f
    designs = [list(c) for c in list(columns)[:terms]] + [[]] * (terms - len(columns))
    rows = _alike(episodes, des, [c for d in designs for c in d], weight).persist()
    try:
        if start is None:
            n, t = F.col("_w"), F.col("tf")
            mean = lambda v: F.sum(n * v) / F.sum(n)
            one = rows.agg(F.sum(n * F.col("_d")).alias("e"), F.sum(n * (t - F.col("ts"))).alias("x"), mean(F.log(t)).alias("m"), F.sqrt(F.greatest(mean(F.log(t) * F.log(t)) - mean(F.log(t)) * mean(F.log(t)), F.lit(0.0))).alias("s"), mean(1 / t).alias("h"), mean(t).alias("w"), F.min(F.when(F.col("_d") > 0, t)).alias("z")).first()
            rate = np.log(max(one.e, 0.5) / one.x)
            spread = np.log(max(one.s or 1.0, 0.1))
            first = {"inverse_gaussian": [rate, 0.5 * np.log(max(one.h - 1 / one.w, 1e-6))], "generalised_gamma": [one.m, spread], "weibull_mixture": [rate, 0.0, -1.0], "log_logistic_mixture": [rate, 0.0, -1.0], "sickle_mixture": [2 * rate, -rate, -1.0], "exponential_mixture": [rate, -1.0], "weibull": [rate, 0.0], "log_logistic": [rate, 0.0], "log_logistic_2": [rate, 0.0, rate], "gompertz_makeham": [rate - 2, rate, -1e-3 * np.exp(rate)], "gompertz": [rate, 0.0], "sickle": [2 * rate, -rate], "log_normal": [one.m, spread], "log_normal_shifted": [one.m, spread, np.log(max(one.z or 1.0, 1e-6) / 2)]}[family]
            start = [v for k, d in enumerate(designs) for v in [first[k], *([0.0] * len(d))]]
        names = [f"{t}:{n}" for t, d in zip("ABC", designs) for n in ["constant", *d]]
        with np.errstate(all="ignore"):
            return maximise(by_predictors(rows, designs, f, ["_d", "ts", "tf"], "_w"), start, names, steps=100)
    finally:
        rows.unpersist()


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)


def polynomial(episodes: DataFrame, columns: Sequence[str] = (), degree: int = 1, exponent: bool = False, des: int | None = None) -> Fit:
    """r = a + sum of c_k t^k or, with exponent, exp(x coef_A + sum of c_k t^k), whose integral is taken by Gauss and Legendre's rule over each episode.

    A rate that is not positive at the end of every episode is no model. The fit is of times as shares of the longest one, so that steps are alike for all powers whatever the unit; coefficients are those of the times given.
    """
    rows = _alike(episodes, des, columns).persist()
    try:
        w = F.col("_w")
        one = rows.agg(F.sum(w * F.col("_d")).alias("e"), F.sum(w * (F.col("tf") - F.col("ts"))).alias("x"), F.max("tf").alias("t")).first()
        unit, rate = float(one.t or 1.0), max(one.e or 0, 0.5) / (one.x or 1.0)

        def loglik(*args):
            (xa, *c), (d, ts, tf) = args[:-3], args[-3:]
            if not exponent:  # the c_k are in units of the constant rate
                a = np.exp(xa)
                slope = lambda t, more: sum(rate * b * (t / unit) ** k * (t / (k + 1) if more else 1) for k, b in enumerate(c, 1))
                r = a + slope(tf, False)
                return d * np.log(np.where(np.real(r) > 0, r, np.nan)) - a * (tf - ts) - slope(tf, True) + slope(ts, True)
            line = lambda t: xa + sum(b * (t / unit) ** k for k, b in enumerate(c, 1))
            half = (tf - ts) / 2
            return d * line(tf) - half * sum(g * np.exp(line(ts + half * (1 + x))) for x, g in zip(_NODES, _WEIGHTS))

        start = [np.log(rate), *([0.0] * (len(columns) + degree))]
        names = ["constant", *columns, *[f"time_{k}" for k in range(1, degree + 1)]]
        with np.errstate(all="ignore"):
            fit = maximise(by_predictors(rows, [list(columns), *([[]] * degree)], loglik, ["_d", "ts", "tf"], "_w"), start, names, steps=100)
    finally:
        rows.unpersist()
    back = np.array([1.0] * (1 + len(columns)) + [(1.0 if exponent else rate) / unit**k for k in range(1, degree + 1)])
    fit.coef, fit.covariance = fit.coef * back, fit.covariance * np.outer(back, back)
    return fit


def discrete_time(episodes: DataFrame, columns: Sequence[str] = (), degree: int = 1, link: str = "logit", des: int | None = None) -> Fit:
    """Whole times: each episode becomes a row for each time at risk, fitted by a logit or cloglog with a polynomial of the time."""
    times = F.explode(F.sequence((F.col("ts") + 1).cast("long"), F.col("tf").cast("long"))).alias("_t")
    rows = episodes.where("floor(tf) > ts").select(*columns, "tf", _event(des).alias("_d"), times)
    powers = {f"time_{k}": F.pow(F.col("_t").cast("double"), F.lit(float(k))) for k in range(1, degree + 1)}
    rows = rows.withColumn("_y", F.when(F.col("_t") == F.floor("tf"), F.col("_d")).otherwise(0.0)).withColumns(powers)
    return glm(rows, "_y", [*powers, *columns], "binomial", link)[0]


def cox(episodes: DataFrame, columns: Sequence[str], strata: Sequence[str] = (), des: int | None = None, steps: int = 30) -> Fit:
    """Partial likelihood with Breslow's ties: an episode is at risk at t where ts < t <= tf. Rows are summed by distinct times; what is at risk is a running sum
    over them of those that started less those that ended. Covariates are centred, so that their exponents stay in range."""
    p, by = len(columns), list(strata)
    rows = episodes.dropna(subset=list(columns))
    means = rows.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    rows = settled(rows.select(*by, "ts", "tf", _event(des).alias("_d"), *[(F.col(c).cast("double") - means[f"m{k}"]).alias(f"x{k}") for k, c in enumerate(columns)]))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def sums(b: np.ndarray):
        e = F.exp(sum((F.col(f"x{k}") * float(v) for k, v in enumerate(b)), F.lit(0.0)))
        parts = {"s": e, **{f"g{k}": e * F.col(f"x{k}") for k in range(p)}, **{f"h{i}_{j}": e * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs}}
        zero = F.lit(0.0)
        ends = rows.select(*by, F.col("tf").alias("t"), "_d", *[(F.col("_d") * F.col(f"x{k}")).alias(f"d{k}") for k in range(p)], *[v.alias(f"out_{n}") for n, v in parts.items()], *[zero.alias(f"in_{n}") for n in parts])
        starts = rows.select(*by, F.col("ts").alias("t"), zero.alias("_d"), *[zero.alias(f"d{k}") for k in range(p)], *[zero.alias(f"out_{n}") for n in parts], *[v.alias(f"in_{n}") for n, v in parts.items()])
        at = ends.unionByName(starts).groupBy(*by, "t").agg(F.sum("_d").alias("_d"), *[F.sum(f"d{k}").alias(f"d{k}") for k in range(p)], *[F.sum(f"{s}_{n}").alias(f"{s}_{n}") for n in parts for s in ("in", "out")])
        # from the last time down: those who end at or after t, less those who start at or after it
        at = running(at, "t", {f"r_{n}": F.col(f"out_{n}") - F.col(f"in_{n}") for n in parts}, by, descending=True).where("_d > 0")
        m = [F.col(f"r_g{k}") / F.col("r_s") for k in range(p)]
        one = at.agg(
            F.sum(F.col("_d") * F.log("r_s")).alias("l"), *[F.sum(f"d{k}").alias(f"d{k}") for k in range(p)], *[F.sum(F.col(f"d{k}") - F.col("_d") * m[k]).alias(f"g{k}") for k in range(p)],
            *[F.sum(F.col("_d") * (F.col(f"r_h{i}_{j}") / F.col("r_s") - m[i] * m[j])).alias(f"i{i}_{j}") for i, j in pairs],
        ).first()
        info = np.array([[one[f"i{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        value = sum(float(v) * one[f"d{k}"] for k, v in enumerate(b)) - one["l"]
        return float(value), np.array([one[f"g{k}"] for k in range(p)]), info

    return maximise(sums, np.zeros(p), list(columns), steps)


def baseline(episodes: DataFrame, fit: Fit, des: int | None = None, strata: Sequence[str] = ()) -> DataFrame:
    """Breslow's cumulated baseline rate of a Cox fit, at all covariates 0: strata, time, events, cumulated_rate, survivor."""
    by = list(strata)
    e = F.exp(sum((F.col(c) * float(v) for c, v in zip(fit.names, fit.coef)), F.lit(0.0)))
    ends = episodes.select(*by, F.col("tf").alias("time"), _event(des).alias("events"), e.alias("r"))
    starts = episodes.select(*by, F.col("ts").alias("time"), F.lit(0.0).alias("events"), (-e).alias("r"))
    at = ends.unionByName(starts).groupBy(*by, "time").agg(F.sum("events").alias("events"), F.sum("r").alias("r"))
    at = running(at, "time", {"_risk": F.col("r")}, by, descending=True).where("events > 0")
    at = running(at, "time", {"cumulated_rate": F.col("events") / F.col("_risk")}, by)
    return at.select(*by, "time", "events", "cumulated_rate", F.exp(-F.col("cumulated_rate")).alias("survivor"))


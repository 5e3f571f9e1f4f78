"""Regression models fitted from sums over rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import np_normal
from ..plans.fitting import Fit, by_predictors, gram, maximise, summed
from ..plans.iterate import settled
from ..plans.ordered import bucket_of, cuts, matches, once, running


def _x(columns: Sequence[str], constant: bool = True) -> list[Column]:
    return ([F.lit(1.0)] if constant else []) + [F.col(c).cast("double") for c in columns]


def least_squares(df: DataFrame, y: str, columns: Sequence[str], weight: str | None = None, constant: bool = True, equal: tuple[np.ndarray, np.ndarray] | None = None) -> Fit:
    """Weighted least squares from one aggregate; equal = (A, b) holds the coefficients to A coef = b. loglik is minus the residual sum of squares."""
    df = df.dropna(subset=[y, *columns])
    s = gram(df, [*_x(columns, constant), F.col(y).cast("double")], None if weight is None else F.col(weight))
    n = df.count()
    xx, xy, yy = s[:-1, :-1], s[:-1, -1], s[-1, -1]
    p = len(xx)
    if equal is None:
        inverse, rank = np.linalg.pinv(xx), p
        b = inverse @ xy
    else:
        a, c = np.atleast_2d(equal[0]).astype(float), np.atleast_1d(equal[1]).astype(float)
        m, rank = len(a), p - np.linalg.matrix_rank(a)
        whole = np.linalg.pinv(np.block([[xx, a.T], [a, np.zeros((m, m))]]))
        b, inverse = (whole @ np.concatenate([xy, c]))[:p], whole[:p, :p]
    rss = float(yy - 2 * b @ xy + b @ xx @ b)
    return Fit((["constant"] if constant else []) + list(columns), b, inverse * max(rss, 0) / max(1, n - rank), -rss, 1)


def constrained_least_squares(df: DataFrame, y: str, columns: Sequence[str], at_least: tuple[np.ndarray, np.ndarray], weight: str | None = None, constant: bool = True, rounds: int = 100_000) -> Fit:
    """Least squares with A coef >= c, at_least = (A, c). One aggregate gives the products; the multipliers of the constraints, few as
    they are, are then found one by one in turn until none moves. No covariance is given; loglik is minus the residual sum of squares."""
    df = df.dropna(subset=[y, *columns])
    s = gram(df, [*_x(columns, constant), F.col(y).cast("double")], None if weight is None else F.col(weight))
    xx, xy, yy = s[:-1, :-1], s[:-1, -1], s[-1, -1]
    a, c = np.atleast_2d(at_least[0]).astype(float), np.atleast_1d(at_least[1]).astype(float)
    inverse = np.linalg.pinv(xx)
    free, push = inverse @ xy, a @ inverse @ a.T
    short, u = c - a @ free, np.zeros(len(c))
    for k in range(1, rounds + 1):
        moved = 0.0
        for i in range(len(c)):
            if push[i, i] > 0:
                new = max(0.0, u[i] + (short[i] - push[i] @ u) / push[i, i])
                moved, u[i] = max(moved, abs(new - u[i]) * push[i, i]), new
        if moved <= 1e-12 * (1 + np.abs(short).max()):
            break
    else:
        raise RuntimeError("the constraints' multipliers have not settled: they may contradict each other")
    b = free + inverse @ a.T @ u
    rss = float(yy - 2 * b @ xy + b @ xx @ b)
    return Fit((["constant"] if constant else []) + list(columns), b, np.full((len(b), len(b)), np.nan), -rss, k)


def fitted(df: DataFrame, fit: Fit, columns: Sequence[str], name: str = "fitted") -> DataFrame:
    value = F.lit(0.0)
    for n, b in zip(fit.names, fit.coef):
        value = value + (F.lit(float(b)) if n == "constant" else F.lit(float(b)) * F.col(n))
    return df.withColumn(name, value)


# generalised linear models, by steps of weighted least squares in built-in functions

_LINKS = {  # inverse, and the derivative of the mean in the predictor
    "identity": (lambda e: e, lambda e, m: F.lit(1.0)),
    "log": (lambda e: F.exp(e), lambda e, m: m),
    "logit": (lambda e: 1 / (1 + F.exp(-e)), lambda e, m: m * (1 - m)),
    "cloglog": (lambda e: 1 - F.exp(-F.exp(e)), lambda e, m: F.exp(e - F.exp(e))),
    "loglog": (lambda e: F.exp(-F.exp(-e)), lambda e, m: F.exp(-e - F.exp(-e))),
    "inverse": (lambda e: 1 / e, lambda e, m: -m * m),
    "inverse_square": (lambda e: 1 / F.sqrt(e), lambda e, m: -0.5 * m * m * m),
    "sqrt": (lambda e: e * e, lambda e, m: 2 * e),
}
_FAMILIES = {  # default link, variance, a first mean, deviance of a row
    "normal": ("identity", lambda m: F.lit(1.0), lambda y: y, lambda y, m: F.pow(y - m, F.lit(2.0))),
    "poisson": ("log", lambda m: m, lambda y: y + 0.1, lambda y, m: 2 * (F.when(y > 0, y * F.log(y / m)).otherwise(0.0) - (y - m))),
    "binomial": ("logit", lambda m: m * (1 - m), lambda y: (y + 0.5) / 2, lambda y, m: 2 * (F.when(y > 0, y * F.log(y / m)).otherwise(0.0) + F.when(y < 1, (1 - y) * F.log((1 - y) / (1 - m))).otherwise(0.0))),
    "gamma": ("log", lambda m: m * m, lambda y: y, lambda y, m: -2 * (F.log(y / m) - (y - m) / m)),
    "inverse_gaussian": ("log", lambda m: m * m * m, lambda y: y, lambda y, m: F.pow(y - m, F.lit(2.0)) / (y * m * m)),
}


def _predictor_of(mean: Column, link: str) -> Column:
    return {"identity": lambda m: m, "log": F.log, "logit": lambda m: F.log(m / (1 - m)), "cloglog": lambda m: F.log(-F.log(1 - m)), "loglog": lambda m: -F.log(-F.log(m)), "inverse": lambda m: 1 / m, "inverse_square": lambda m: 1 / (m * m), "sqrt": F.sqrt}[link](mean)


def glm(df: DataFrame, y: str, columns: Sequence[str], family: str = "poisson", link: str | None = None, offset: str | None = None, weight: str | None = None, steps: int = 50, tol: float = 1e-10) -> tuple[Fit, float]:
    """A generalised linear model and its deviance. Every step is one aggregate of built-in functions; the last one gives the information."""
    default, variance, first, deviance = _FAMILIES[family]
    link = link or default
    inverse, slope = _LINKS[link]
    df = df.dropna(subset=[y, *columns]).persist()
    try:
        yc, off = F.col(y).cast("double"), F.lit(0.0) if offset is None else F.col(offset).cast("double")
        w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
        x, b, was = _x(columns), None, None
        for k in range(1, steps + 1):
            eta = _predictor_of(first(yc), link) if b is None else sum((c * float(v) for c, v in zip(x, b)), off)
            rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], yc.alias("y"), w.alias("w"), off.alias("o"), eta.alias("eta")).withColumn("m", inverse(F.col("eta")))
            rows = rows.withColumn("d", slope(F.col("eta"), F.col("m")))
            working = F.col("eta") - F.col("o") + (F.col("y") - F.col("m")) / F.col("d")
            s = gram(rows, [*[F.col(f"x{i}") for i in range(len(x))], working], F.col("w") * F.col("d") * F.col("d") / variance(F.col("m")))
            new = np.linalg.solve(s[:-1, :-1], s[:-1, -1])
            done = b is not None and np.abs(new - b).max() <= tol * (1 + np.abs(b).max()) * 100
            b = new
            if done:
                break
        eta = sum((c * float(v) for c, v in zip(x, b)), off)
        m = inverse(eta)
        dev, n = df.agg(F.sum(w * deviance(yc, m)), F.count("*")).first()
        scale = 1.0 if family in ("poisson", "binomial") else dev / max(1, n - len(b))
        return Fit(["constant", *columns], b, np.linalg.inv(s[:-1, :-1]) * scale, -dev / 2, k), float(dev)
    finally:
        df.unpersist()


def logit(df: DataFrame, y: str, columns: Sequence[str], weight: str | None = None) -> Fit:
    """Binary logit for y of 0 and 1; loglik is the log-likelihood."""
    return glm(df, y, columns, "binomial", weight=weight)[0]


def _log_normal_cdf(z: np.ndarray) -> np.ndarray:
    """ln Phi for real z, and its first-order extension for the complex steps of derivatives."""
    r = np.real(z)
    p = np.maximum(np_normal(r), 1e-300)
    out = np.log(p)
    return out + 1j * np.imag(z) * np.exp(-r * r / 2) / np.sqrt(2 * np.pi) / p if np.iscomplexobj(z) else out


def probit(df: DataFrame, y: str, columns: Sequence[str], weight: str | None = None) -> Fit:
    f = lambda eta, v: _log_normal_cdf((2 * v - 1) * eta)
    df = df.dropna(subset=[y, *columns]).persist()
    try:
        return maximise(by_predictors(df, [columns], f, [y], weight), np.zeros(1 + len(columns)), ["constant", *columns])
    finally:
        df.unpersist()


def ordinal(df: DataFrame, y: str, columns: Sequence[str], categories: Sequence[int], kind: str = "logit") -> Fit:
    """Cumulative logit or probit: P(Y <= k) = F(cut_k - x coef). Parameters: the first cut, the logs of the steps between cuts, the coefficients."""
    cats, p = sorted(categories), len(columns)
    m = len(cats) - 1
    df = df.dropna(subset=[y, *columns]).select(*[F.col(c).cast("double").alias(c) for c in [y, *columns]]).persist()
    cdf = (lambda z: 1 / (1 + np.exp(-z))) if kind == "logit" else np_normal
    size = m + p

    def value(b: np.ndarray, x: np.ndarray, k: np.ndarray) -> np.ndarray:
        top = np.concatenate([[-np.inf], np.cumsum(np.concatenate([b[:1], np.exp(b[1:m])])), [np.inf]])
        eta = x @ b[m:] if p else np.zeros(len(k))
        return np.log(np.maximum(cdf(top[k + 1] - eta) - cdf(top[k] - eta), 1e-300))

    def sums(b: np.ndarray):
        def batch(f: pd.DataFrame) -> np.ndarray:
            x, k = f[list(columns)].to_numpy().reshape(len(f), p), np.searchsorted(cats, f[y].to_numpy())
            base, h, eye = value(b, x, k), 1e-4, np.eye(size)
            grad, info = np.zeros(size), np.zeros((size, size))
            up = [value(b + h * e, x, k) for e in eye]
            down = [value(b - h * e, x, k) for e in eye]
            for i in range(size):
                grad[i] = ((up[i] - down[i]) / (2 * h)).sum()
                info[i, i] = -((up[i] + down[i] - 2 * base) / h**2).sum()
                for j in range(i):
                    cross = value(b + h * (eye[i] + eye[j]), x, k) - value(b + h * (eye[i] - eye[j]), x, k) - value(b - h * (eye[i] - eye[j]), x, k) + value(b - h * (eye[i] + eye[j]), x, k)
                    info[i, j] = info[j, i] = -(cross / (4 * h * h)).sum()
            return np.concatenate([[base.sum()], grad, info.ravel()])

        s = summed(df, 1 + size + size * size, batch)
        return float(s[0]), s[1 : 1 + size], s[1 + size :].reshape(size, size)

    try:
        start = np.zeros(size)
        start[0] = -1.0
        return maximise(sums, start, ["cut_1", *[f"log_step_{k}" for k in range(2, m + 1)], *columns], tol=1e-8)
    finally:
        df.unpersist()


def multinomial(df: DataFrame, y: str, columns: Sequence[str], categories: Sequence[int]) -> Fit:
    """Multinomial logit against the first category: analytic sums of gradient and information."""
    cats, p = sorted(categories), 1 + len(columns)
    m = len(cats) - 1
    size = m * p
    df = df.dropna(subset=[y, *columns]).select(*[F.col(c).cast("double").alias(c) for c in [y, *columns]]).persist()

    def sums(b: np.ndarray):
        def batch(f: pd.DataFrame) -> np.ndarray:
            x = np.column_stack([np.ones(len(f)), f[list(columns)].to_numpy().reshape(len(f), p - 1)])
            k = np.searchsorted(cats, f[y].to_numpy())
            z = np.column_stack([np.zeros(len(f)), x @ b.reshape(m, p).T])
            z = z - z.max(1, keepdims=True)
            q = np.exp(z)
            total = q.sum(1, keepdims=True)
            q = q / total
            value = (z[np.arange(len(f)), k] - np.log(total[:, 0])).sum()
            own = (k[:, None] == np.arange(1, m + 1)) - q[:, 1:]
            info = np.zeros((size, size))
            for i in range(m):
                for j in range(m):
                    w = q[:, i + 1] * ((i == j) - q[:, j + 1])
                    info[i * p : (i + 1) * p, j * p : (j + 1) * p] = (x.T * w) @ x
            return np.concatenate([[value], (own.T @ x).ravel(), info.ravel()])

        s = summed(df, 1 + size + size * size, batch)
        return float(s[0]), s[1 : 1 + size], s[1 + size :].reshape(size, size)

    try:
        return maximise(sums, np.zeros(size), [f"{c}:{n}" for c in cats[1:] for n in ["constant", *columns]])
    finally:
        df.unpersist()


def conditional_logit(df: DataFrame, case: str, chosen: str, columns: Sequence[str]) -> Fit:
    """A row for each alternative of a case; chosen is 1 for one of them. Shares come from sums over the alternatives of a case."""
    x, p = [F.col(c).cast("double") for c in columns], len(columns)
    df = df.dropna(subset=[case, chosen, *columns]).select(F.col(case).alias("_case"), F.col(chosen).cast("double").alias("_y"), *[v.alias(f"x{k}") for k, v in enumerate(x)]).persist()

    def sums(b: np.ndarray):
        eta = sum((F.col(f"x{k}") * float(v) for k, v in enumerate(b)), F.lit(0.0))
        rows = df.withColumn("_e", F.exp(eta))
        aggs = [F.log(F.sum("_e")).alias("_l"), F.sum(F.col("_y") * eta).alias("_v")]
        aggs += [(F.sum(F.col("_e") * F.col(f"x{k}")) / F.sum("_e")).alias(f"m{k}") for k in range(p)] + [F.sum(F.col("_y") * F.col(f"x{k}")).alias(f"s{k}") for k in range(p)]
        aggs += [(F.sum(F.col("_e") * F.col(f"x{i}") * F.col(f"x{j}")) / F.sum("_e")).alias(f"q{i}_{j}") for i in range(p) for j in range(i, p)]
        per = rows.groupBy("_case").agg(*aggs)
        one = per.agg(F.sum(F.col("_v") - F.col("_l")).alias("v"), *[F.sum(F.col(f"s{k}") - F.col(f"m{k}")).alias(f"g{k}") for k in range(p)], *[F.sum(F.col(f"q{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"i{i}_{j}") for i in range(p) for j in range(i, p)]).first()
        info = np.array([[one[f"i{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        return float(one["v"]), np.array([one[f"g{k}"] for k in range(p)]), info

    try:
        return maximise(sums, np.zeros(p), list(columns))
    finally:
        df.unpersist()


def rasch(df: DataFrame, items: Sequence[str], steps: int = 100) -> DataFrame:
    """Item difficulties of the Rasch model by conditional likelihood (item, solved, difficulty; they add up to 0). Rows are counted by their total score and
    each item's successes: as many numbers as items squared reach the driver, where the elementary symmetric functions are solved."""
    k = len(items)
    score = sum((F.col(c).cast("int") for c in items), F.lit(0))
    got = df.dropna(subset=list(items)).groupBy(score.alias("r")).agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("int")).alias(f"s{i}") for i, c in enumerate(items)]).where(F.col("r").between(1, k - 1)).collect()
    n = {r.r: r.n for r in got}
    solved = np.array([sum(r[f"s{i}"] for r in got) for i in range(k)], float)
    d = np.zeros(k)

    def gamma(e: np.ndarray) -> np.ndarray:
        g = np.zeros(len(e) + 1)
        g[0] = 1
        for v in e:
            g[1:] = g[1:] + v * g[:-1]
        return g

    for _ in range(steps):
        e = np.exp(-d)
        whole = gamma(e)
        expect = np.zeros(k)
        for i in range(k):
            without = gamma(np.delete(e, i))
            expect[i] = sum(c * e[i] * without[r - 1] / whole[r] for r, c in n.items())
        move = np.log(np.maximum(expect, 1e-12) / np.maximum(solved, 1e-12))
        d = d + move
        d -= d.mean()
        if np.abs(move - move.mean()).max() < 1e-10:
            break
    return df.sparkSession.createDataFrame([(c, int(s), float(v)) for c, s, v in zip(items, solved, d)], "item string, solved long, difficulty double")


def median_regression(df: DataFrame, y: str, columns: Sequence[str], stages: int = 6) -> Fit:
    """Least absolute deviations: Newton steps for the sum of sqrt(r^2 + e^2), with e ten times smaller in each stage, down to
    10^-(stages - 1) of the mean residual of least squares. A step is one aggregate. loglik is minus the sum of absolute
    residuals; no covariance is given."""
    df = df.dropna(subset=[y, *columns]).persist()
    try:
        x, yc = _x(columns), F.col(y).cast("double")
        p, s = len(x), gram(df, [*x, yc])
        b, steps = np.linalg.pinv(s[:-1, :-1]) @ s[:-1, -1], 0
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        residual = lambda at: yc - sum((c * float(v) for c, v in zip(x, at)), F.lit(0.0))
        scale = df.agg(F.avg(F.abs(residual(b)))).first()[0] or 0.0
        for k in range(stages if scale > 0 else 0):
            e = F.lit(scale * 10.0**-k)

            def sums(at, e=e):
                r = residual(at)
                size = F.sqrt(r * r + e * e)
                bend = e * e / (size * size * size)
                row = df.agg(-F.sum(size), *[F.sum(c * r / size) for c in x], *[F.sum(x[i] * x[j] * bend) for i, j in pairs]).first()
                info = np.zeros((p, p))
                for v, (i, j) in zip(row[1 + p :], pairs):
                    info[i, j] = info[j, i] = v
                return float(row[0]), np.array(row[1 : 1 + p], float), info

            fit = maximise(sums, b, ["constant", *columns], steps=60, tol=1e-10)
            b, steps = fit.coef, steps + fit.steps
        total = df.agg(F.sum(F.abs(residual(b)))).first()[0]
        return Fit(["constant", *columns], b, np.full((p, p), np.nan), -float(total or 0.0), steps)
    finally:
        df.unpersist()


def nonlinear(df: DataFrame, y: str, names: Sequence[str], start: Sequence[float], mean, columns: Sequence[str], steps: int = 100) -> Fit:
    """Least squares for mean(b, *columns) in numpy (it must take complex b): Gauss-Newton from sums of the derivatives' products."""
    df = df.dropna(subset=[y, *columns]).select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([y, *columns])]).persist()
    p = len(start)

    def sums(b: np.ndarray):
        def batch(f: pd.DataFrame) -> np.ndarray:
            data = [f[c].to_numpy() for c in columns]
            r = f[y].to_numpy() - mean(b, *data)
            j = np.column_stack([np.broadcast_to(np.imag(mean(b + 1e-20j * (np.arange(p) == k), *data)) / 1e-20, r.shape) for k in range(p)])
            return np.concatenate([[-(r @ r) / 2], j.T @ r, (j.T @ j).ravel()])

        s = summed(df, 1 + p + p * p, batch)
        return float(s[0]), s[1 : 1 + p], s[1 + p :].reshape(p, p)

    try:
        fit = maximise(sums, start, names, steps)
        fit.covariance = fit.covariance * (-2 * fit.loglik) / max(1, df.count() - p)
        return fit
    finally:
        df.unpersist()


def censored_least_squares(df: DataFrame, y: str, observed: str, columns: Sequence[str], steps: int = 30, tol: float = 1e-5) -> Fit:
    """Buckley and James: censored values are replaced by the mean of what the product-limit distribution of residuals leaves above theirs, then least squares again."""
    df = settled(df.dropna(subset=[y, observed, *columns]).select(F.col(y).cast("double").alias("_y"), F.col(observed).cast("int").alias("_d"), *[F.col(c).cast("double").alias(c) for c in columns]))
    fit = least_squares(df, "_y", columns)
    for k in range(steps):
        rows = fitted(df, fit, columns, "_f").withColumn("_r", F.round(F.col("_y") - F.col("_f"), 12))
        cells = rows.groupBy("_r").agg(F.sum("_d").alias("_e"), F.count("*").alias("_n"))
        cells = running(cells, "_r", {"_risk": F.col("_n")}, descending=True)
        cells = cells.withColumn("_q", F.least(F.col("_e") / F.col("_risk"), F.lit(1.0)))
        cells = running(cells, "_r", {"_log": F.when(F.col("_q") < 1, F.log(1 - F.col("_q"))).otherwise(0.0), "_zero": F.when(F.col("_q") >= 1, 1).otherwise(0)})
        before = F.exp(F.col("_log") - F.when(F.col("_q") < 1, F.log(1 - F.col("_q"))).otherwise(0.0)) * F.when((F.col("_zero") == 0) | ((F.col("_zero") == 1) & (F.col("_q") >= 1)), 1.0).otherwise(0.0)
        cells = cells.withColumns({"_s": F.when(F.col("_zero") > 0, 0.0).otherwise(F.exp("_log")), "_mass": before * F.col("_q")})
        cells = settled(running(cells, "_r", {"_above": F.col("_mass") * F.col("_r"), "_left": F.col("_mass")}, descending=True, exclusive=True).select("_r", "_above", "_left"))
        rows = rows.join(cells, "_r").withColumn("_z", F.when((F.col("_d") == 1) | (F.col("_left") <= 1e-12), F.col("_y")).otherwise(F.col("_f") + F.col("_above") / F.col("_left")))
        new = least_squares(rows, "_z", columns)
        moved = np.abs(new.coef - fit.coef).max()
        fit = Fit(new.names, new.coef, new.covariance, new.loglik, k + 1)
        if moved <= tol * (1 + np.abs(fit.coef).max()):
            break
    return fit


def loglinear(df: DataFrame, columns: Sequence[str], margins: Sequence[Sequence[str]], weight: str | None = None, rounds: int = 100, eps: float = 1e-8) -> DataFrame:
    """Expected counts under a log-linear model that fits margins, by iterative proportional fitting over the table of cells (all combinations of the
    categories seen): columns, n, fitted. Margins are sums over partitions of the cells."""
    n = F.count("*").cast("double") if weight is None else F.sum(weight).cast("double")
    seen, full = df.dropna(subset=list(columns)).groupBy(*columns).agg(n.alias("n")), None
    for c in columns:
        values = seen.select(c).distinct()
        full = values if full is None else full.join(values)  # categories times categories
    cells = settled(full.join(seen, list(columns), "left").select(*columns, F.coalesce("n", F.lit(0.0)).alias("n"), F.lit(1.0).alias("fitted")))
    for _ in range(rounds):
        step = cells
        for m in margins:
            w = Window.partitionBy(*m)
            have, want = F.sum("fitted").over(w), F.sum("n").over(w)
            step = step.withColumn("fitted", F.when(have > 0, F.col("fitted") * want / have).otherwise(0.0))
        step = settled(step.withColumnRenamed("fitted", "_new").join(cells.select(*columns, F.col("fitted").alias("_old")), list(columns)).select(*columns, "n", F.col("_new").alias("fitted"), "_old"))
        moved = step.agg(F.max(F.abs(F.col("fitted") - F.col("_old")))).first()[0] or 0.0
        cells = step.drop("_old")
        if moved <= eps:
            break
    return cells


def fit_statistics(cells: DataFrame, parameters: int) -> DataFrame:
    """chi2, lr and df of a fitted table."""
    f, n = F.col("fitted"), F.col("n")
    return cells.agg(F.sum(F.when(f > 0, F.pow(n - f, F.lit(2.0)) / f).otherwise(0.0)).alias("chi2"), (2 * F.sum(F.when(n > 0, n * F.log(n / f)).otherwise(0.0))).alias("lr"), (F.count("*") - parameters).alias("df"))


def monotone(df: DataFrame, x: str, y: str, weight: str | None = None, by: Sequence[str] = (), rising: bool = True) -> DataFrame:
    """The best monotone fit: by, x, fitted. Values are first pooled by distinct x; adjacent violators are then pooled inside blocks of x, and the
    steps that are left of each block pooled again over the whole of a group, in one task: at most as many as distinct x."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    cells = df.dropna(subset=[x, y]).groupBy(*by, F.col(x).cast("double").alias("_x")).agg(F.sum(w * F.col(y)).alias("_s"), F.sum(w).alias("_w"))
    cells = once(cells).select(*by, F.col("_x").alias("_low"), F.col("_x").alias("_high"), "_s", "_w", bucket_of(F.col("_x"), cuts(cells, F.col("_x"))).alias("_b"))
    sign = 1 if rising else -1

    def pool(f: pd.DataFrame) -> pd.DataFrame:
        f, out = f.sort_values("_low"), []
        for low, high, s, n in zip(f["_low"], f["_high"], f["_s"] * sign, f["_w"]):
            while out and out[-1][2] * n >= s * out[-1][3]:
                low, s, n = out[-1][0], s + out[-1][2], n + out.pop()[3]
            out.append([low, high, s, n])
        g = pd.DataFrame(out, columns=["_low", "_high", "_s", "_w"])
        g["_s"] *= sign
        for c in [*by, "_b"]:
            g[c] = f[c].iloc[0]
        return g[list(f.columns)]

    first = cells.groupBy(*by, "_b").applyInPandas(pool, cells.schema)
    steps = first.groupBy(*(by or [F.lit(1).alias("_all")])).applyInPandas(pool, cells.schema)
    values = df.dropna(subset=[x, y]).select(*by, F.col(x).cast("double").alias("x")).distinct()
    marks = steps.select(*by, F.col("_low").alias("x"), (F.col("_s") / F.col("_w")).alias("_v"))
    joined = matches(values, marks, [*by, "x"], "left")
    count = running(joined, "x", {"_k": F.when(F.col("_v").isNotNull(), 1).otherwise(0)}, by)
    tops = count.where("_v is not null").select(*by, "_k", F.col("_v").alias("fitted"))
    return matches(count.drop("_v"), tops, [*by, "_k"]).select(*by, "x", "fitted")


def monotone_projection(df: DataFrame, order: str, y: str, ties: str = "secondary", name: str = "fitted") -> DataFrame:
    """df with the nearest values of y that don't fall along order. Among rows of one order, secondary ties get one value; primary
    ones are put in the order of y first, so that they need not be equal."""
    df = df.where(F.col(order).isNotNull() & F.col(y).isNotNull())
    if ties == "secondary":
        fit = monotone(df, order, y)
        return matches(df.withColumn("_o", F.col(order).cast("double")), fit.select(F.col("x").alias("_o"), F.col("fitted").alias(name)), ["_o"]).drop("_o")
    if ties != "primary":
        raise ValueError("ties are primary or secondary")
    groups = running(df.groupBy(F.col(order).cast("double").alias("_o")).agg(F.count("*").alias("_n")), "_o", {"_before": F.col("_n")}, exclusive=True)
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_o").orderBy(y))
    ranked = settled(matches(df.withColumn("_o", F.col(order).cast("double")), groups.select("_o", "_before"), ["_o"]).withColumn("_k", rank.cast("double")).drop("_o", "_before"))
    fit = monotone(ranked, "_k", y)
    return matches(ranked, fit.select(F.col("x").alias("_k"), F.col("fitted").alias(name)), ["_k"]).drop("_k")

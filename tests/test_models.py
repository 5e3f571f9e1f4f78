"""Estimates against published values, closed forms and simulated truth."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.operators import clusters, describe, episodes, graphs, intervals, rates, regression, sequences, smoothing, survival
from epochal.plans.fitting import maximise

#: Remission of leukaemia patients (weeks, 1 = relapse), the classic two groups.
TREATED = [(6, 1), (6, 1), (6, 1), (6, 0), (7, 1), (9, 0), (10, 1), (10, 0), (11, 0), (13, 1), (16, 1), (17, 0), (19, 0), (20, 0), (22, 1), (23, 1), (25, 0), (32, 0), (32, 0), (34, 0), (35, 0)]
PLACEBO = [(t, 1) for t in (1, 1, 2, 2, 3, 4, 4, 5, 5, 8, 8, 8, 8, 11, 11, 12, 12, 15, 17, 22, 23)]


@pytest.fixture(scope="module")
def remission(spark):
    rows = [(k, float(t), d, g) for k, (t, d, g) in enumerate([(*r, 1) for r in TREATED] + [(*r, 0) for r in PLACEBO])]
    df = spark.createDataFrame(rows, "id long, tf double, d int, grp int")
    return episodes.checked(episodes.define(df, F.lit(0), "tf", 0, "d", "id", keep=["grp"]))


def test_product_limit(remission):
    out = survival.product_limit(remission.where("grp = 1")).orderBy("time").collect()
    assert [r.time for r in out] == [6, 7, 10, 13, 16, 22, 23]
    assert [r.survivor for r in out] == pytest.approx([0.85714, 0.80672, 0.75294, 0.69020, 0.62745, 0.53782, 0.44818], abs=1e-5)
    assert [r.se for r in out[:1]] == pytest.approx([0.07636], abs=1e-5)
    assert [r.censored for r in out] == [0, 1, 1, 2, 0, 3, 0]
    half = survival.survivor_times(survival.product_limit(remission.where("grp = 1"))).first()
    assert half.time == pytest.approx(22.42, abs=0.01)
    last = survival.product_limit(remission.where("grp = 0")).orderBy(F.desc("time")).first()
    assert (last.survivor, last.se, last.cumulated_rate) == (0.0, -1.0, None)


def test_weights_are_rows(remission):
    twice = survival.product_limit(remission.union(remission), ["grp"]).orderBy("grp", "time").collect()
    weighted = survival.product_limit(remission.withColumn("w", F.lit(2.0)), ["grp"], weight="w").orderBy("grp", "time").collect()
    assert [(r.grp, r.time, r.risk) for r in twice] == [(r.grp, r.time, r.risk) for r in weighted]
    assert [r.survivor for r in twice] == pytest.approx([r.survivor for r in weighted])


def test_tests(remission):
    got = {r.test: r for r in survival.compare(remission, "grp").collect()}
    assert got["log-rank"].statistic == pytest.approx(16.79, abs=0.01)
    assert got["Breslow"].statistic == pytest.approx(13.46, abs=0.01)
    assert got["log-rank"].cdf > 0.9999


def test_cox(remission):
    fit = rates.cox(remission, ["grp"])
    assert fit.coef[0] == pytest.approx(-1.509, abs=2e-3)
    assert fit.se[0] == pytest.approx(0.4096, abs=2e-3)
    base = rates.baseline(remission, fit).orderBy("time").collect()
    assert all(a.cumulated_rate < b.cumulated_rate for a, b in zip(base, base[1:]))
    # entries that are late and end at once don't change who is at risk
    late = remission.withColumn("ts", F.lit(0.5))
    assert rates.cox(late, ["grp"]).coef[0] == pytest.approx(fit.coef[0], abs=1e-6)


def test_exponential_and_pieces(remission):
    fit = rates.exponential(remission, ["grp"])
    a, b = 21 / sum(t for t, _ in PLACEBO), 9 / sum(t for t, _ in TREATED)
    assert fit.coef == pytest.approx([np.log(a), np.log(b / a)], abs=1e-6)
    one = rates.null_exponential(remission).first()
    assert one.loglik == pytest.approx(30 * np.log(30 / 541) - 30)
    pieces = rates.piecewise(remission, [0, 10, 20])
    direct = {r.period: r.rate for r in rates.occurrence_rates(remission, [0, 10, 20]).collect()}
    assert pieces.coef[0] == pytest.approx(np.log(direct[0]), abs=1e-6)
    assert pieces.coef[2] == pytest.approx(np.log(direct[2] / direct[0]), abs=1e-6)


def simulated(spark, times, x):
    rows = [(k, float(min(t, 5.0)), int(t <= 5.0), float(z)) for k, (t, z) in enumerate(zip(times, x))]
    df = spark.createDataFrame(rows, "id long, tf double, d int, x double")
    return episodes.checked(episodes.define(df, F.lit(0), "tf", 0, "d", "id", keep=["x"]))


def test_parametric_models(spark):
    rng = np.random.default_rng(7)
    n = 4000
    x = rng.integers(0, 2, n).astype(float)
    a = np.exp(-1 + 0.5 * x)
    u = rng.random(n)
    weibull = (-np.log(u)) ** (1 / 1.5) / a
    fit = rates.parametric(simulated(spark, weibull, x), "weibull", [["x"], []])
    assert fit.coef == pytest.approx([-1, 0.5, np.log(1.5)], abs=0.08)
    logistic = ((1 - u) / u) ** (1 / 2.0) / a
    fit = rates.parametric(simulated(spark, logistic, x), "log_logistic", [["x"], []])
    assert fit.coef == pytest.approx([-1, 0.5, np.log(2.0)], abs=0.1)
    normal = np.exp(1 + 0.3 * x + 0.8 * rng.normal(size=n))
    fit = rates.parametric(simulated(spark, normal, x), "log_normal", [["x"], []])
    assert fit.coef == pytest.approx([1, 0.3, np.log(0.8)], abs=0.1)
    gompertz = np.log(1 - np.log(u) * 0.4 / 0.2) / 0.4
    fit = rates.parametric(simulated(spark, gompertz, x), "gompertz", [[], []])
    assert fit.coef == pytest.approx([np.log(0.2), 0.4], abs=0.12)


def test_polynomials_and_mixture(spark):
    rng = np.random.default_rng(8)
    n, x = 4000, np.zeros(4000)
    e = -np.log(rng.random(n))
    fit = rates.polynomial(simulated(spark, (-0.2 + np.sqrt(0.04 + 0.4 * e)) / 0.2, x))
    assert (np.exp(fit.coef[0]), fit.coef[1]) == pytest.approx((0.2, 0.2), abs=0.05)
    fit = rates.polynomial(simulated(spark, np.log(1 + e * 0.4 / 0.2) / 0.4, x), exponent=True)
    assert fit.coef == pytest.approx([np.log(0.2), 0.4], abs=0.12)
    frail = rng.gamma(1 / 0.8, 0.8, n)
    fit = rates.parametric(simulated(spark, e / (0.5 * frail), x), "exponential_mixture", [[], []])
    assert (np.exp(fit.coef[0]), np.exp(fit.coef[1])) == pytest.approx((0.5, 0.8), abs=0.15)


def test_gamma_and_wiener_times(spark):
    rng = np.random.default_rng(11)
    n, x = 4000, rng.integers(0, 2, 4000).astype(float)
    # ln t = a + b sqrt(k) (ln g - ln k), g from a gamma distribution of shape k
    for k in (1.0, 2.5):
        t = np.exp(0.3 + 0.4 * x + 0.7 * np.sqrt(k) * (np.log(rng.gamma(k, 1.0, n)) - np.log(k)))
        fit = rates.parametric(simulated(spark, t, x), "generalised_gamma", [["x"], []], shape=k)
        assert fit.coef == pytest.approx([0.3, 0.4, np.log(0.7)], abs=0.08)
    t = rng.wald(1 / (0.6 + 0.3 * x), 1 / 0.8**2)
    fit = rates.parametric(simulated(spark, t, x), "inverse_gaussian", [["x"], []])
    assert fit.coef == pytest.approx([0.6, 0.3, np.log(0.8)], abs=0.08)


def test_mixed_families(spark):
    rng = np.random.default_rng(12)
    n, x = 6000, np.zeros(6000)
    for v in (0.5, 1.0):
        e = -np.log(rng.random(n)) / rng.gamma(1 / v, v, n)  # cumulative rate at the event
        fit = rates.parametric(simulated(spark, e ** (1 / 1.8) / 0.6, x), "weibull_mixture")
        assert np.exp(fit.coef) == pytest.approx([0.6, 1.8, v], rel=0.3)
        with np.errstate(over="ignore"):
            t = np.expm1(e) ** (1 / 2.5) / 0.7
        fit = rates.parametric(simulated(spark, np.where(np.isfinite(t), t, 1e9), x), "log_logistic_mixture")
        # its likelihood is flat in one direction: the survivor function is what is known
        a, b, w = np.exp(fit.coef)
        for at in (0.5, 1.0, 2.0, 4.0):
            assert (1 + w * np.log1p((a * at) ** b)) ** (-1 / w) == pytest.approx(np.mean(t > at), abs=0.03)
        grid = np.linspace(0, 60, 20001)
        whole = 0.8 * 1.5 * (1.5 - (grid + 1.5) * np.exp(-grid / 1.5))
        t = np.where(e < whole[-1], np.interp(e, whole, grid), 1e9)
        fit = rates.parametric(simulated(spark, t, x), "sickle_mixture")
        a, b, w = np.exp(fit.coef)
        for at in (0.5, 1.0, 2.0, 4.0):
            assert (1 + w * a * b * (b - (at + b) * np.exp(-at / b))) ** (-1 / w) == pytest.approx(np.mean(t > at), abs=0.03)


def test_least_absolute_deviations(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(1, 50, 800).astype(float)
    y = 3 * x + rng.standard_t(2, 800) * 20
    fit = regression.median_regression(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double"), "y", ["x"])
    at = lambda m: np.abs(y - m * x - np.median(y - m * x)).sum()
    low, high = -10.0, 20.0
    for _ in range(100):  # convex in the slope
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if at(a) < at(b) else (a, high)
    assert -fit.loglik == pytest.approx(at((low + high) / 2), rel=1e-6)


def test_discrete_time(spark):
    rng = np.random.default_rng(3)
    p = 1 / (1 + np.exp(2.0))
    times = rng.geometric(p, 3000)
    fit = rates.discrete_time(simulated(spark, times.astype(float), np.zeros(3000)), degree=0)
    assert fit.coef[0] == pytest.approx(-2.0, abs=0.1)


def test_split_keeps_time_and_events(remission):
    parts = episodes.split(remission, times=[5, 10, 20, 100])
    a, b = (df.agg(F.sum(F.col("tf") - F.col("ts")), F.sum((F.col("des") != F.col("org")).cast("int"))).first() for df in (remission, parts))
    assert tuple(a) == tuple(b)
    assert parts.count() > remission.count()


def test_regressions(spark):
    rng = np.random.default_rng(5)
    n = 3000
    x, z = rng.normal(size=n), rng.normal(size=n)
    eta = 0.5 + 1.0 * x
    latent = eta + rng.logistic(size=n)
    rows = [(float(a), float(b), float(1 + 2 * a - b + 0.1 * e), float(m > 0), int(m > -1) + int(m > 1), float(g > -(0.3 + 0.8 * a))) for a, b, e, m, g in zip(x, z, rng.normal(size=n), latent, rng.normal(size=n))]
    df = spark.createDataFrame(rows, "x double, z double, y double, b double, o int, p double")
    assert regression.least_squares(df, "y", ["x", "z"]).coef == pytest.approx([1, 2, -1], abs=0.02)
    held = regression.least_squares(df, "y", ["x", "z"], equal=(np.array([[0, 1, 1]]), np.array([1.0])))
    assert held.coef[1] + held.coef[2] == pytest.approx(1.0, abs=1e-8)
    assert regression.logit(df, "b", ["x"]).coef == pytest.approx([0.5, 1.0], abs=0.15)
    assert regression.probit(df, "p", ["x"]).coef == pytest.approx([0.3, 0.8], abs=0.12)
    ordinal = regression.ordinal(df, "o", ["x"], [0, 1, 2])
    assert (ordinal.coef[0], ordinal.coef[0] + np.exp(ordinal.coef[1]), ordinal.coef[2]) == pytest.approx((-1.5, 0.5, 1.0), abs=0.2)
    assert regression.median_regression(df, "y", ["x", "z"]).coef == pytest.approx([1, 2, -1], abs=0.03)
    fit = regression.nonlinear(df.withColumn("y", F.exp(0.3 * F.col("x")) + 1), "y", ["a", "b"], [0.0, 0.1], lambda b, v: b[0] + np.exp(b[1] * v), ["x"])
    assert fit.coef == pytest.approx([1.0, 0.3], abs=1e-6)


def test_conditional_logit_and_rasch(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(1500):
        v = rng.normal(size=3)
        best = (1.2 * v + rng.gumbel(size=3)).argmax()
        rows += [(k, int(j == best), float(v[j])) for j in range(3)]
    fit = regression.conditional_logit(spark.createDataFrame(rows, "k long, y int, v double"), "k", "y", ["v"])
    assert fit.coef[0] == pytest.approx(1.2, abs=0.15)
    d = np.array([-1.0, 0.0, 1.0])
    ability = rng.normal(size=3000)
    solved = (rng.random((3000, 3)) < 1 / (1 + np.exp(-(ability[:, None] - d)))).astype(int)
    out = regression.rasch(spark.createDataFrame(solved.tolist(), "a int, b int, c int"), ["a", "b", "c"]).collect()
    assert [r.difficulty for r in out] == pytest.approx(d.tolist(), abs=0.15)


def test_censored_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=1500)
    y = 1 + 0.7 * x + 0.5 * rng.normal(size=1500)
    c = 1.6 + 0.5 * rng.normal(size=1500)
    df = spark.createDataFrame([(float(min(a, b)), int(a <= b), float(z)) for a, b, z in zip(y, c, x)], "y double, d int, x double")
    fit = regression.censored_least_squares(df, "y", "d", ["x"], steps=8)
    assert fit.coef == pytest.approx([1, 0.7], abs=0.1)


def test_monotone(spark):
    df = spark.createDataFrame([(float(k), y) for k, y in enumerate([1.0, 3.0, 2.0, 4.0, 3.0, 3.5, 6.0])], "x double, y double")
    assert [r.fitted for r in regression.monotone(df, "x", "y").orderBy("x").collect()] == pytest.approx([1, 2.5, 2.5, 3.5, 3.5, 3.5, 6])


def test_rank_correlation_equals_pairs(spark):
    rng = np.random.default_rng(11)
    x, y = rng.integers(0, 60, 900), rng.integers(0, 25, 900)
    want = sum(np.sign(x[i] - x[:i]) @ np.sign(y[i] - y[:i]) for i in range(900)) / (900 * 899 / 2)
    got = describe.rank_correlation(spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x int, y int"), "x", "y", buckets=8).first()
    assert (got.n, got.tau) == (900, pytest.approx(want, abs=1e-12))


def test_optimal_matching(spark):
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 4, rng.integers(0, 9)).tolist() for _ in range(40)] + [[1, 2], [1, 2]]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "id long, states array<int>")
    pairs, members = sequences.optimal_matching(df, block=7)
    number = {r.id: r.number for r in members.collect()}
    got = {(r.a, r.b): r.distance for r in pairs.collect()}

    def distance(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + 2 * (a[i - 1] != b[j - 1]))
        return d[len(a)][len(b)]

    assert number[40] == number[41]
    for i, j in itertools.combinations(range(42), 2):
        a, b = sorted((number[i], number[j]))
        assert a == b or got[a, b] == distance(seqs[i], seqs[j])


def test_graph_edges(spark):
    cyc = graphs.define(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "i long, j long"))
    assert {r.node: r.component for r in graphs.strong_components(cyc).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    levels = {r.node: r.level for r in graphs.topological(cyc).collect()}
    assert levels[5] == 0 and levels[6] == 1 and levels[1] is None
    e = graphs.define(spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (1, 3, 3.0), (3, 4, 1.0)], "i long, j long, v double"), v="v", directed=False)
    assert sorted((r.i, r.j) for r in graphs.spanning_tree(e).collect()) == [(1, 2), (2, 3), (3, 4)]
    ring = graphs.define(spark.createDataFrame([(k, (k + 1) % 6) for k in range(6)], "i long, j long"), directed=False)
    value, _ = graphs.leading_eigenvector(ring)
    assert value == pytest.approx(2.0, abs=1e-6)
    empty = e.limit(0)
    assert graphs.components(empty).count() == graphs.closure(empty).count() == graphs.spanning_tree(empty).count() == 0
    long = graphs.define(spark.createDataFrame([(k, k + 1) for k in range(200)], "i long, j long"))
    assert {r.component for r in graphs.components(long).collect()} == {0}


def test_intervals(spark):
    df = spark.createDataFrame([(0.0, 2.0), (1.0, 1.0), (1.0, 3.0)], "lo double, hi double")
    got = {r.x: (r.lower, r.upper, r.mean) for r in intervals.distribution_bounds(df).collect()}
    assert got[1.0] == pytest.approx((1 / 3, 1.0, 0.5)) and got[2.0] == pytest.approx((2 / 3, 1.0, 2.5 / 3)) and got[3.0] == pytest.approx((1, 1, 1))
    known = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (1, 2)], "lo int, hi int")
    assert {r.value: r.share for r in intervals.self_consistent(known).collect()} == pytest.approx({1: 2 / 3, 2: 1 / 3}, abs=1e-5)
    sets = known.select(F.sequence("lo", "hi").alias("s"))
    assert {r.value: r.share for r in intervals.set_distribution(sets, "s").collect()} == pytest.approx({1: 2 / 3, 2: 1 / 3}, abs=1e-5)
    bounds = {r.term: (r.lower, r.upper) for r in intervals.least_squares_bounds(spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 2.0, 1.0)], "lo double, hi double, x double"), "lo", "hi", ["x"]).collect()}
    assert bounds["x"] == pytest.approx((1, 2)) and bounds["constant"] == pytest.approx((0, 0), abs=1e-9)


def test_clusters(spark):
    rows = [(k, float(10 * (k % 3) + (k * 7 % 5) / 10)) for k in range(60)]
    centres, out, _ = clusters.means(spark.createDataFrame(rows, "id long, x double"), ["x"], 3)
    assert sorted(centres[:, 0].round().tolist()) == [0, 10, 20]
    assert out.groupBy("cluster").count().agg(F.min("count")).first()[0] == 20
    d = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0)], "i long, j long, v double")
    assert clusters.metric_constant(d).first().constant == pytest.approx(3.0)


def test_smoothers(spark):
    rows = [(1, k, float(k)) for k in range(20)]
    df = spark.createDataFrame(rows, "g int, k long, x double")
    assert [r.smooth for r in smoothing.lowess(df, "k", "x", ["g"]).orderBy("k").collect()] == pytest.approx(range(20), abs=1e-8)
    assert [r.s for r in smoothing.resistant(df, "x", "k", "s", "3H", ["g"]).orderBy("k").collect()] == pytest.approx(range(20))
    assert [r.smooth for r in smoothing.spline(df, "k", "x", ["g"]).orderBy("k").collect()] == pytest.approx(range(20), abs=1e-3)


def test_events_at_the_ends_of_periods(spark):
    rows = [(1, 12.0, 1), (2, 12.0, 0), (3, 24.0, 1), (4, 5.0, 1), (5, 30.0, 1), (6, 30.0, 0), (7, 11.0, 1)]
    e = episodes.checked(episodes.define(spark.createDataFrame(rows, "id long, tf double, d int"), F.lit(0), "tf", 0, "d", "id"))
    got = {r.period: (r.events, r.exposure) for r in rates.occurrence_rates(e, [0, 12, 24]).collect()}
    assert got == {0: (2, 5 + 11 + 5 * 12), 1: (1, 3 * 12), 2: (2, 12)}  # events at 12 and 24 are those of the periods that begin there
    fit = rates.piecewise(e, [0, 12, 24])
    log = [np.log(d / x) for d, x in got.values()]
    assert fit.coef == pytest.approx([log[0], log[1] - log[0], log[2] - log[0]], abs=1e-7)
    assert fit.loglik == pytest.approx(sum(d * np.log(d / x) - d for d, x in got.values()))
    x = e.withColumn("x", F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.0))
    by = rates.piecewise(x, [0, 12], ["x"], specific=True)
    for z in (0, 1):
        cell = {r.period: np.log(r.rate) for r in rates.occurrence_rates(x.where(F.col("x") == z), [0, 12]).where("events > 0").collect()}
        b = dict(zip(by.names, by.coef))
        for k, v in cell.items():
            assert b["constant"] + z * b["x"] + (b["period_1"] + z * b["x_1"] if k else 0) == pytest.approx(v, abs=1e-6)


def test_polynomials_of_long_times(spark):
    """Estimates and their errors don't depend on the unit of time, in which t^2 may be 10^6."""
    rng = np.random.default_rng(12)
    u = rng.random(3000)
    rows = [(k, float(np.round(min(t, 900.0), 1)) + 0.1, int(t <= 900.0), float(k % 2)) for k, t in enumerate(-np.log(u) / 0.004)]
    df = spark.createDataFrame(rows, "id long, tf double, d int, x double")
    of = lambda unit: episodes.checked(episodes.define(df.withColumn("tf", F.col("tf") / unit), F.lit(0), "tf", 0, "d", "id", keep=["x"]))
    for exponent in (False, True):
        long_, short = (rates.polynomial(of(unit), ["x"], 2, exponent) for unit in (1.0, 1000.0))
        assert long_.converged and short.converged
        back = np.array([1, 1, 1e3, 1e6]) if exponent else np.array([1, 1, 1e6, 1e9])
        move = np.array([np.log(1000.0), 0, 0, 0])
        assert long_.coef * back + move == pytest.approx(short.coef, rel=1e-4, abs=1e-5)
        assert long_.se * back == pytest.approx(short.se, rel=1e-4)
    # against sums by numpy: the score of exp(a + b t) at the estimate is 0
    fit = rates.polynomial(of(1.0), [], 1, True)
    a, b = fit.coef
    tf, d = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    grown = (np.exp(a + b * tf) - np.exp(a)) / b
    assert d.sum() == pytest.approx(grown.sum(), rel=1e-6)
    assert (d * tf).sum() == pytest.approx((tf * np.exp(a + b * tf) / b - grown / b).sum(), rel=1e-5)


def test_estimates_that_do_not_settle(spark):
    """Exponential times have no constant besides b exp(c t): its log falls for ever."""
    u = np.random.default_rng(3).random(400)
    e = simulated(spark, -np.log(u) * 3, np.zeros(400)).withColumn("tf", F.col("tf") * 1.0)
    with pytest.warns(RuntimeWarning, match="not settled"):
        fit = maximise(lambda b: (-float(np.exp(-b[0])), np.exp(-b), np.diag(np.exp(-b))), [0.0], ["b"], steps=20)
    assert not fit.converged
    assert rates.exponential(e).converged


def test_more_families(spark):
    rng = np.random.default_rng(17)
    n, x = 4000, np.zeros(4000)
    u = rng.random(n)
    # S = (1 + (a t)^b)^(-c / a), a = 1/2, b = 2, c = 1/3
    times = ((u ** (-0.5 / (1 / 3)) - 1) ** 0.5) / 0.5
    fit = rates.parametric(simulated(spark, times, x), "log_logistic_2")
    assert fit.converged and np.exp(fit.coef) == pytest.approx([0.5, 2, 1 / 3], rel=0.2)
    shifted = 0.5 + np.exp(0.3 + 0.6 * rng.normal(size=n))
    fit = rates.parametric(simulated(spark, shifted, x), "log_normal_shifted")
    assert fit.converged and fit.coef == pytest.approx([0.3, np.log(0.6), np.log(0.5)], abs=0.15)
    plain = rates.parametric(simulated(spark, shifted, x), "log_normal")
    assert fit.loglik > plain.loglik

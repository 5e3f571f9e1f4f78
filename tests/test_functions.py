"""Row and special functions against numpy and known values; ordered columns over many buckets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.functions import columns, scalar, special
from epochal.plans.ordered import bucket_of, positions, running


def test_special_functions_known_values():
    assert special.np_normal(np.array([0.0, 1.96, -3.0])) == pytest.approx([0.5, 0.9750021048517795, 0.0013498980316300957], rel=1e-12)
    assert special.np_normal_quantile(np.array([0.5, 0.975, 1e-6])) == pytest.approx([0, 1.959963984540054, -4.753424308822899], abs=1e-10)
    assert special.np_chi2(np.array([3.841458820694124, 0.0]), 1) == pytest.approx([0.95, 0.0], abs=1e-12)
    assert special.np_student(np.array([2.2281388519649385, -1.0]), 10) == pytest.approx([0.975, 0.17044656615103004], abs=1e-10)
    assert special.np_fisher(np.array([4.964602743730711]), 1, 10) == pytest.approx([0.95], abs=1e-10)
    assert special.np_bivariate_normal(0.0, 0.0, 0.5) == pytest.approx(1 / 3, abs=1e-10)
    assert special.np_incomplete_gamma(np.array([1.0, 3.0]), np.array([2.0, 9.0])) == pytest.approx([1 - math.exp(-2), 0.9937678048936227], abs=1e-12)


def test_row_functions(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 5.0), (3.0, 0.0), (-8.0, 2.5), (-2.5, 3.0), (7.0, 3.0)], "a double, b double")
    got = df.select(scalar.divide("a", "b"), scalar.power("a", "b"), scalar.rounded("a"), scalar.remainder("a", "b")).collect()
    assert [r[0] for r in got] == [0.0, 0.0, None, -3.2, pytest.approx(-2.5 / 3), pytest.approx(7 / 3)]
    assert [r[1] for r in got] == [0.0, 0.0, 1.0, 64.0, pytest.approx(-15.625), 343.0]
    assert [r[2] for r in got] == [0.0, 0.0, 3.0, -8.0, -3.0, 7.0]
    assert [r[3] for r in got] == [None, 0.0, None, None, None, 1.0]
    x = [0.3, 1.0, 4.5, 20.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    out = df.select(scalar.log_gamma("x"), scalar.digamma("x"), scalar.trigamma("x"), scalar.binomial(F.lit(10.0), F.floor("x").cast("double"))).collect()
    assert [r[0] for r in out] == pytest.approx([math.lgamma(v) for v in x], abs=1e-10)
    h = 1e-5
    assert [r[1] for r in out] == pytest.approx([(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x], rel=1e-6)
    assert [r[2] for r in out] == pytest.approx([(math.lgamma(v + 1e-3) - 2 * math.lgamma(v) + math.lgamma(v - 1e-3)) / 1e-6 for v in x], rel=1e-3)
    assert [r[3] for r in out] == [1.0, 10.0, 210.0, 0.0]
    bad = spark.range(1).select(scalar.julian(F.lit(2023), F.lit(2), F.lit(30)), scalar.julian(F.lit(2000), F.lit(1), F.lit(1))).first()
    assert tuple(bad) == (None, 2451545)


def test_sequence_functions(spark):
    df = spark.createDataFrame([([-1, 2, -1, -1, 2, 3, -1],), ([-1, -1],), ([],), ([1, -1, 2],), ([5, None, 5],)], "s array<int>")
    got = df.select(scalar.span("s"), scalar.gaps("s"), scalar.filled("s", 2)).collect()
    assert [tuple(r)[:2] for r in got] == [(5, 2), (0, 0), (0, 0), (3, 1), (3, 1)]
    assert [r[2] for r in got] == [[-1, 2, 2, 2, 2, 3, -1], [-1, -1], [], [1, -1, 2], [5, 5, 5]]


def test_running_over_many_buckets(spark):
    rng = np.random.default_rng(0)
    x = rng.permutation(5000)
    v = rng.integers(0, 100, 5000)
    df = spark.createDataFrame([(int(a), int(b), int(a) % 3) for a, b in zip(x, v)], "k long, v long, g int").repartition(5)
    got = {r.k: (r.s, r.p) for r in positions(running(df, "k", {"s": F.col("v")}), "k", "p").collect()}
    by_k = v[np.argsort(x)]
    total = np.cumsum(by_k)
    assert all(got[k] == (total[k], k + 1) for k in range(5000))
    down = {r.k: r.s for r in running(df, "k", {"s": F.col("v")}, ["g"], descending=True, exclusive=True).collect()}
    for g in range(3):
        own = by_k[g::3]
        rest = own[::-1].cumsum()[::-1] - own
        assert [down[k] for k in range(g, 5000, 3)] == rest.tolist()
    assert running(df.limit(0), "k", {"s": F.col("v")}).count() == 0


def test_buckets(spark):
    df = spark.range(10).select(bucket_of(F.col("id"), [2, 5, 7]).alias("b"))
    assert [r.b for r in df.collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]


def test_recursive_column(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (1, 3, 8.0), (2, 1, 1.0)], "g int, k int, x double")
    out = columns.folded(df, lambda last, r: last * 2 + r["x"], F.lit(1.0), "k", ["x"], "y", ["g"])
    assert sorted((r.g, r.k, r.y) for r in out.collect()) == [(1, 1, 4.0), (1, 2, 12.0), (1, 3, 32.0), (2, 1, 3.0)]

"""Functions that no query calls, against plain Python."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epochal.functions import columns
from epochal.operators import clusters, episodes, graphs, intervals, joins, matrices, regression, sequences, smoothing, spatial
from epochal.plans import ordered
from epochal.sources import sinks, text


def test_uniform_numbers_by_key(spark):
    df = spark.range(3000).withColumn("k", F.col("id") % 600).withColumn("u", columns.uniform_by("k", seed=4))
    rows = {(r.k, r.u) for r in df.select("k", "u").collect()}
    u = np.array([x for _, x in rows])
    assert len(rows) == 600 and 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.05
    assert rows == {(r.k, r.u) for r in df.repartition(7).select("k", "u").collect()}
    assert rows != {(r.k, r.u) for r in df.withColumn("u", columns.uniform_by("k", seed=5)).select("k", "u").collect()}


def test_sorted_records(spark):
    lines = ["b 2 é", "a 9 z", "a 1 z", "B 2 a", "a 1 y", ""]
    got = [r.value for r in joins.sorted_records(spark.createDataFrame([(x,) for x in lines], "value string"), "value", [(3, 3), (1, 1)]).collect()]
    assert [(x[2:3], x[:1]) for x in got] == sorted((x[2:3], x[:1]) for x in lines)


def test_blocks_of_matrices(spark):
    rng = np.random.default_rng(1)
    f = pd.DataFrame({"g": np.repeat([1, 2, 3], 5), "a": rng.normal(size=15), "b": rng.normal(size=15)})
    out = matrices.per_block(spark.createDataFrame(f), "g", ["a", "b"], lambda m: m.T @ m, "x double, y double").toPandas()
    for g, part in f.groupby("g"):
        m = part[["a", "b"]].to_numpy()
        assert np.allclose(np.sort(out[out.g == g][["x", "y"]].to_numpy(), axis=0), np.sort(m.T @ m, axis=0))


def test_projected_population(spark):
    birth, stay = np.array([0.0, 1.2, 0.4]), np.array([0.9, 0.7])
    out = matrices.projected_population(np.array([100.0, 50.0, 20.0]), birth, stay, 3, spark, migration=np.array([1.0, 0.0, 0.0]))
    leslie = np.array([birth, [0.9, 0, 0], [0, 0.7, 0]])
    n = np.array([100.0, 50.0, 20.0])
    for t in range(4):
        assert [r.n for r in out.where(f"step = {t}").orderBy("age").collect()] == pytest.approx(n.tolist())
        n = leslie @ n + np.array([1.0, 0, 0])


def shapes(spark, rows):
    return spark.createDataFrame(rows, f"id long, shape {spatial.SHAPE}")


def test_lines_in_polygons(spark):
    polygons = shapes(spark, [(1, [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]), (2, [(20.0, 0.0), (30.0, 0.0), (30.0, 4.0), (24.0, 4.0), (24.0, 8.0), (30.0, 8.0), (30.0, 12.0), (20.0, 12.0)])])
    lines = shapes(spark, [
        (1, [(1.0, 1.0), (9.0, 9.0)]), (2, [(1.0, 1.0), (11.0, 9.0)]), (3, [(28.0, 2.0), (28.0, 10.0)]),  # both ends inside, but over the notch
        (4, [(21.0, 1.0), (23.0, 11.0)]), (5, [(50.0, 50.0), (51.0, 51.0)]), (6, [(5.0, 5.0)]),
    ])
    got = sorted((r.object, r.polygon) for r in spatial.contained(lines, polygons).collect())
    assert got == [(1, 1), (4, 2), (6, 1)]


def test_networks_of_lines(spark):
    lines = shapes(spark, [(1, [(0.0, 0.0), (3.0, 4.0)]), (2, [(3.01, 4.02), (3.0, 10.0)]), (3, [(0.02, -0.01), (0.0, 5.0), (3.0, 10.0)])])
    nodes, edges = spatial.network(lines, 0.5)
    at = {r.node: (r.x, r.y) for r in nodes.collect()}
    assert sorted(at.values()) == [(0.0, 0.0), (3.0, 4.0), (3.0, 10.0)]
    got = sorted((at[r.i], at[r.j], round(r.v, 3)) for r in edges.collect())
    assert got == sorted([((0.0, 0.0), (3.0, 4.0), 5.0), ((3.0, 4.0), (3.0, 10.0), round(float(np.hypot(0.01, 5.98)), 3)), ((0.0, 0.0), (3.0, 10.0), round(float(np.hypot(0.02, 5.01) + np.hypot(3, 5)), 3))])


def test_sequences_of_episodes(spark):
    rows = [(1, 0, 3, 5, 6), (1, 3, 6, 6, 7), (1, 8, 9, 7, 7), (2, 1, 4, 2, 2), (3, 20, 30, 1, 1)]
    e = episodes.define(spark.createDataFrame(rows, "id long, a int, b int, o int, d int"), "a", "b", "o", "d", "id")
    got = {r.id: r.states for r in sequences.from_episodes(e, range(10)).collect()}
    assert got == {1: [5, 5, 5, 6, 6, 6, -1, -1, 7, -1], 2: [-1, 2, 2, 2, -1, -1, -1, -1, -1, -1], 3: [-1] * 10}


def test_random_sequences(spark):
    out = sequences.random(spark, 400, 25, 4, seed=3)
    rows = {r.id: r.states for r in out.collect()}
    assert len(rows) == 400 and all(len(s) == 25 for s in rows.values())
    counts = np.bincount([x for s in rows.values() for x in s], minlength=4)
    assert len(counts) == 4 and abs(counts / counts.sum() - 0.25).max() < 0.02
    assert rows == {r.id: r.states for r in sequences.random(spark, 400, 25, 4, seed=3).collect()}


def test_parts_and_bytes(spark, tmp_path):
    df = spark.createDataFrame([(f"line {k}",) for k in range(25)], "value string").coalesce(1)
    sinks.parts(df, str(tmp_path / "p"), 10)
    parts = sorted((tmp_path / "p").glob("part-*"))
    assert sorted(len(p.read_text().splitlines()) for p in parts) == [5, 10, 10]
    assert sorted(x for p in parts for x in p.read_text().splitlines()) == sorted(f"line {k}" for k in range(25))
    (tmp_path / "b").write_bytes(bytes(range(100)))
    assert text.hex_dump(spark, str(tmp_path / "b"), 10, 5).first().hex == "0A0B0C0D0E"


@pytest.mark.parametrize("by", [(), ("g",)])
def test_running_sums_over_many_buckets(spark, monkeypatch, by):
    """With buckets of few rows each level cuts those of the one before: some thousand buckets give the same sums."""
    rng = np.random.default_rng(6)
    f = pd.DataFrame({"g": rng.integers(0, 3, 5000), "x": rng.permutation(5000).astype(float), "v": rng.integers(0, 9, 5000)})
    monkeypatch.setattr(ordered, "LEAST", 1)
    monkeypatch.setattr(ordered, "ROWS", 3)
    df = spark.createDataFrame(f)
    assert ordered.bucketed(df, "x", 12)[0].select("_bucket").distinct().count() > 1000
    got = ordered.running(df, "x", {"s": F.col("v")}, by, buckets=12).toPandas().sort_values("x")
    f = f.sort_values("x")
    want = f.groupby("g")["v"].cumsum() if by else f["v"].cumsum()
    assert got["s"].tolist() == want.tolist()
    got = ordered.running(df, "x", {"s": F.col("v")}, by, descending=True, exclusive=True, buckets=12).toPandas().sort_values("x", ascending=False)
    f = f.sort_values("x", ascending=False)
    want = (f.groupby("g")["v"].cumsum() if by else f["v"].cumsum()) - f["v"]
    assert got["s"].tolist() == want.tolist()


def test_strong_components(spark):
    rng = np.random.default_rng(2)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (110, 2))})
    reach = np.eye(60, dtype=bool)
    for a, b in edges:
        reach[a, b] = True
    for k in range(60):
        reach |= reach[:, k : k + 1] & reach[k]
    held = {x for e in edges for x in e}
    want = {n: int(np.flatnonzero(reach[n] & reach[:, n])[0]) for n in held}
    got = {r.node: r.component for r in graphs.strong_components(spark.createDataFrame(edges, "i long, j long")).collect()}
    assert got == want and len(set(want.values())) < len(held)


def test_splines_against_dense_solutions(spark):
    rng = np.random.default_rng(5)
    f = pd.DataFrame({"g": np.repeat([0, 1, 2], [400, 90, 3]), "x": rng.permutation(493) / 7.0})
    f["y"] = np.sin(f.x / 9) + rng.normal(0, 0.1, len(f))
    df = spark.createDataFrame(f).repartition(5)
    got = smoothing.spline(df, "x", "y", ["g"]).toPandas()
    whole = smoothing.spline(df, "x", "y", []).toPandas()
    for part, out in [*((f[f.g == g], got[got.g == g]) for g in range(3)), (f, whole)]:
        q = {float(np.sort(part.x)[max(0, int(np.ceil(k / 29 * len(part))) - 1)]) for k in range(1, 29)}
        low, span = part.x.min(), max(np.ptp(part.x), 1e-12)
        knots = np.array(sorted((k - low) / span for k in q if part.x.min() < k < part.x.max()))
        basis = smoothing._basis((part.x.to_numpy() - low) / span, knots)
        b = np.linalg.lstsq(basis.T @ basis + np.diag([0.0] * 4 + [1e-4 * len(part)] * len(knots)), basis.T @ part.y.to_numpy(), rcond=None)[0]
        want = dict(zip(part.x, basis @ b))
        assert len(out) == len(part) and max(abs(want[r.x] - r.smooth) for r in out.itertuples()) < 1e-5


def test_variance_of_intervals(spark):
    rng = np.random.default_rng(9)
    for wide in (0.05, 0.5, 3.0):
        a = np.round(rng.normal(size=60), 3)
        b = a + np.round(rng.random(60) * wide, 3) + 0.001
        got = intervals.variance_bounds(spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "lo double, hi double")).first()
        grid = np.linspace(a.min(), b.max(), 200_001)
        step = lambda m: np.maximum(0, np.maximum(a - m, m - b))
        low, high = a.min(), b.max()
        for _ in range(200):
            p, q = low + (high - low) / 3, high - (high - low) / 3
            low, high = (low, q) if (step(p) ** 2).sum() < (step(q) ** 2).sum() else (p, high)
        assert got.variance_least == pytest.approx((step(low) ** 2).mean(), abs=1e-9) and len(grid)
        assert (got.mean_lo, got.mean_hi, got.variance_lo, got.variance_hi) == pytest.approx((a.mean(), b.mean(), a.var(), b.var()))
        if got.variance_most is not None:  # no single change of an end does better
            x = np.where((a + b) / 2 < got.mean_lo, a, b)
            better = True
            while better:
                better = False
                for k in range(60):
                    y = x.copy()
                    y[k] = a[k] + b[k] - x[k]
                    if y.var() > x.var() + 1e-12:
                        x, better = y, True
            assert got.variance_most >= x.var() - 1e-9
        else:
            assert wide > 0.05
    assert intervals.variance_bounds(spark.createDataFrame([], "lo double, hi double")).count() == 0


def test_means_above(spark):
    rows = [(0.0, 4.0), (1.0, 2.0), (1.0, 5.0), (3.0, 3.5)]
    got = {r.x: r.mean for r in intervals.means_above(spark.createDataFrame(rows, "lo double, hi double")).collect()}
    for x in (0.0, 1.0, 3.0):
        share = [max(0.0, b - max(a, x)) / (b - a) for a, b in rows]
        want = sum(s * (max(a, x) + b) / 2 for s, (a, b) in zip(share, rows)) / sum(share)
        assert got[x] == pytest.approx(want)
    assert set(got) == {0.0, 1.0, 3.0}


def test_constrained_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -0.5, 0.2] + 2 + rng.normal(0, 0.3, 300)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    least = (np.array([[0, 0, 1, 0], [0, -1, 0, 0], [0, 1, 1, 1]], float), np.array([0.0, -0.8, 0.9]))
    fit = regression.constrained_least_squares(df, "y", ["a", "b", "c"], least)
    full = np.column_stack([np.ones(300), x])
    slack = least[0] @ fit.coef - least[1]
    assert slack.min() > -1e-8
    pull = full.T @ (full @ fit.coef - y)  # is a combination of the binding constraints, none with a weight below 0
    binding = least[0][slack < 1e-7]
    weight, *_ = np.linalg.lstsq(binding.T, pull, rcond=None)
    assert np.allclose(binding.T @ weight, pull, atol=1e-5) and weight.min() > -1e-6
    assert regression.constrained_least_squares(df, "y", ["a"], (np.array([[0.0, 1.0]]), np.array([-9.0]))).coef == pytest.approx(regression.least_squares(df, "y", ["a"]).coef)


def test_projections_with_ties(spark):
    df = spark.createDataFrame(list(zip(range(6), [1, 1, 2, 3, 3, 3], [5.0, 3.0, 4.0, 6.0, 2.0, 7.0])), "id long, t int, x double")
    got = {r.id: r.fitted for r in regression.monotone_projection(df, "t", "x", "primary").collect()}
    # in the order 3 5 4 2 6 7: the middle three are pooled
    assert got == pytest.approx({1: 3.0, 0: 11 / 3, 2: 11 / 3, 4: 11 / 3, 3: 6.0, 5: 7.0})
    got = {r.id: r.fitted for r in regression.monotone_projection(df, "t", "x").collect()}
    assert got == pytest.approx({0: 4.0, 1: 4.0, 2: 4.0, 3: 5.0, 4: 5.0, 5: 5.0})


@pytest.mark.parametrize("linkage", sorted(clusters.LINKAGES))
def test_linkages(spark, linkage):
    """Joins by definition: distances between the members of clusters, or between their centres."""
    rng = np.random.default_rng(7)
    points = {g: rng.normal(size=(9, 2)) for g in (1, 2)}
    squared = linkage in ("centroid", "median", "ward")
    rows = [(g, i, j, float(((p[i] - p[j]) ** 2).sum() ** (1.0 if squared else 0.5))) for g, p in points.items() for i in range(9) for j in range(i)]
    out = clusters.hierarchical(spark.createDataFrame(rows, "g int, i int, j int, v double"), linkage, ["g"]).toPandas()
    for g, p in points.items():
        parts, centre = {k: [k] for k in range(9)}, {k: p[k] for k in range(9)}
        dist = {(min(i, j), max(i, j)): v for h, i, j, v in rows if h == g}

        def between(a, b):
            pairs = [dist[min(i, j), max(i, j)] for i in parts[a] for j in parts[b]]
            if linkage in ("single", "complete", "average"):
                return {"single": min, "complete": max, "average": np.mean}[linkage](pairs)
            c = ((np.mean(p[parts[a]], axis=0) - np.mean(p[parts[b]], axis=0)) ** 2).sum()
            if linkage == "centroid":
                return c
            if linkage == "ward":
                return 2 * len(parts[a]) * len(parts[b]) / (len(parts[a]) + len(parts[b])) * c
            return ((centre[a] - centre[b]) ** 2).sum()

        for r in out[out.g == g].sort_values("step").itertuples():
            if linkage != "weighted":
                best = min((between(a, b), a, b) for a in parts for b in parts if a < b)
                assert (r.a, r.b) == best[1:] and r.v == pytest.approx(best[0])
            centre[r.a] = (centre[r.a] + centre[r.b]) / 2
            parts[r.a] = parts[r.a] + parts.pop(r.b)
            assert r.size == len(parts[r.a])
        assert len(parts) == 1


def test_largest_variance(spark):
    """All choices of ends by brute force; where it isn't exact, the best is between what is found and the bound."""
    rng = np.random.default_rng(8)
    cases = [[(0, 4), (1, 2), (1, 5), (3, 3.5)], [(0, 2)] * 5, [(1, 1)], [(0, 2), (-1, 3), (-2, 4), (1, 1)], [(5, 5)] * 4]
    for n in (3, 8, 12):
        a = rng.integers(0, 12, n) * 1.0
        cases.append(list(zip(a, a + rng.integers(0, 8, n))))
    shift = 1e6 + rng.random(12) * 3
    cases.append(list(zip(shift, shift + rng.random(12))))
    for case in cases:
        got = intervals.largest_variance(spark.createDataFrame([(float(a), float(b)) for a, b in case], "lo double, hi double")).first()
        want = max(np.var(x) for x in itertools.product(*case))
        assert got.exact and (got.n, got.largest) == (len(case), pytest.approx(want, rel=1e-9, abs=1e-9)), case
    a = rng.random(400) * 10
    many = spark.createDataFrame([(float(x), float(x + 3 * w)) for x, w in zip(a, rng.random(400))], "lo double, hi double")
    got = intervals.largest_variance(many).first()
    assert got.largest <= got.at_most <= got.largest + 9 / 20
    same = spark.range(300_000).select(F.lit(1.0).alias("lo"), F.lit(4.0).alias("hi"))
    got = intervals.largest_variance(same.union(spark.createDataFrame([(9.0, 9.0)], "lo double, hi double"))).first()
    k = np.arange(300_001)
    total, squares = 9 + k + (300_000 - k) * 4.0, 81 + k + (300_000 - k) * 16.0
    assert got.exact and got.largest == pytest.approx((squares / 300_001 - (total / 300_001) ** 2).max(), rel=1e-12)
    assert intervals.largest_variance(many.limit(0)).count() == 0


def test_sums_before_in_the_order_of_strings(spark):
    names = [f"{chr(97 + k % 26)}{k * 7919 % 1009}" for k in range(3000)]
    rows = sorted(set(names))
    df = spark.createDataFrame([(w, float(k % 5)) for k, w in enumerate(rows)], "w string, v double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    try:
        got = {r.w: (r.n, r.s) for r in ordered.sums_before(df, "w", {"n": F.lit(1), "s": "v"}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = 0.0
    for k, w in enumerate(rows):
        assert got[w] == (k, total)
        total += k % 5
    assert ordered.sums_before(df.limit(0), "w", {"n": F.lit(1)}).count() == 0

"""Blocks, cycles, polygons, long series and tall matrices against brute force."""

import itertools
import random
import sys
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epochal.functions.special import np_bivariate_normal
from epochal.operators import blocks, correspondence, delaunay, graphs, lowess, orthants, planar, regression, smoothing, tall

rng = random.Random(11)
GRAPHS = {
    "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(170)],
    "chain_and_hub": [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(60, 100)] + [(5, 40), (190, 199), (7, 7), (41, 40)],
    "one": [(2, 1)],
}


def simple(pairs):
    return sorted({(min(a, b), max(a, b)) for a, b in pairs if a != b})


def by_search(edges):
    """Each edge and the smallest one of its block, by a search in depth."""
    sys.setrecursionlimit(10_000)
    near, seen, low, open_, out = {}, {}, {}, [], []
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)

    def visit(v, above):
        seen[v] = low[v] = len(seen)
        for w in near[v]:
            if w not in seen:
                open_.append((v, w))
                visit(w, v)
                low[v] = min(low[v], low[w])
                if low[w] >= seen[v]:
                    block = []
                    while not block or block[-1] != (v, w):
                        block.append(open_.pop())
                    block = [(min(x), max(x)) for x in block]
                    out.extend((*x, *min(block)) for x in block)
            elif w != above and seen[w] < seen[v]:
                open_.append((v, w))
                low[v] = min(low[v], seen[w])

    for v in sorted(near):
        if v not in seen:
            visit(v, None)
    return sorted(out)


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_blocks(spark, name):
    df = spark.createDataFrame([*GRAPHS[name], (None, 3)], "i long, j long").withColumn("v", F.lit(1.0))
    found = blocks.blocks(df).cache()
    want = by_search(simple(GRAPHS[name]))
    assert sorted(map(tuple, found.collect())) == want
    of = {}
    for i, j, *b in want:
        for v in (i, j):
            of.setdefault(v, set()).add(tuple(b))
    assert sorted(map(tuple, blocks.cut_nodes(found).collect())) == sorted((v, len(b)) for v, b in of.items() if len(b) > 1)
    assert sorted(map(tuple, blocks.bridges(found).collect())) == sorted(b for b in {w[2:] for w in want} if sum(w[2:] == b for w in want) == 1)


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_cycles(spark, name):
    edges = simple(GRAPHS[name])
    walks = {}
    for r in blocks.cycles(spark.createDataFrame(GRAPHS[name], "i long, j long")).collect():
        walks.setdefault((r.i, r.j), {})[r.place] = r.node
    for (i, j), w in walks.items():
        walk = [w[k] for k in range(len(w))]
        assert (walk[0], walk[-1]) == (i, j) and len(set(walk)) == len(walk) > 2
        assert all((min(p), max(p)) in edges for p in zip(walk, walk[1:]))
    part = {v: v for e in edges for v in e}

    def root(v):
        return v if part[v] == v else root(part[v])

    for a, b in edges:
        part[root(a)] = root(b)
    assert len(walks) == len(edges) - len(part) + sum(part[v] == v for v in part)


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_cliques(spark, name):
    edges = simple(GRAPHS[name] + [(a, b) for a in range(5, 12) for b in range(a) if (a, b) not in ((7, 3), (9, 5))] * (name == "random"))
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    grown, want = [[v] for v in sorted(near)], set()
    while grown:
        c = grown.pop()
        common = set.intersection(*(near[v] for v in c))
        if not common:
            want.add(tuple(c))
        grown += [[*c, v] for v in common if v > c[-1]]
    got = [tuple(r.clique) for r in blocks.cliques(spark.createDataFrame(edges, "i long, j long")).collect()]
    assert sorted(got) == sorted(want)


def test_no_edges(spark):
    none = spark.createDataFrame([(1, 1)], "i long, j long")
    assert blocks.blocks(none).collect() == [] and blocks.cycles(none).collect() == []


def faces(spark, segments):
    df = spark.createDataFrame([tuple(map(float, s)) for s in segments], "x1 double, y1 double, x2 double, y2 double")
    found = planar.polygons(df).cache()
    out = {}
    for r in found.collect():
        out.setdefault(r.polygon, {})[r.place] = (round(r.x, 6), round(r.y, 6))
    return [[w[k] for k in range(len(w))] for w in out.values()], planar.areas(found)


def test_two_triangles(spark):
    got, areas = faces(spark, [(0, 0, 10, 0), (10, 0, 5, 8), (5, 8, 0, 0), (10, 0, 5, -8), (5, -8, 0, 0), (5, 8, 5, 20), (40, 40, 41, 41), (3, 3, 3, 3)])
    assert sorted(got) == [[(0, 0), (5, -8), (10, 0)], [(0, 0), (10, 0), (5, 8)]]
    assert [r.area for r in areas.collect()] == pytest.approx([40, 40])


def test_crossing_and_overlapping_lines(spark):
    got, areas = faces(spark, [(0, k, 10, k) for k in range(11)] + [(k, -1, k, 11) for k in range(11)] + [(2, 3, 7, 3), (-5, 4, 5, 4), (0.5, 0.5, 0.5, 0.5001)])
    assert len(got) == 100 and areas.agg(F.min("area"), F.max("area"), F.max("nodes")).first() == pytest.approx((1, 1, 4))


def test_faces_of_random_lines(spark):
    """As many as edges less nodes plus parts; the areas make up the outline's."""
    draw = random.Random(5)
    lines = [(0, 0, 10, 0), (10, 0, 10, 10), (10, 10, 0, 10), (0, 10, 0, 0)]
    lines += [(0, draw.random() * 10, 10, draw.random() * 10) for _ in range(12)] + [(draw.random() * 10, 0, draw.random() * 10, 10) for _ in range(12)]
    got, areas = faces(spark, lines)
    e = planar.pieces(spark.createDataFrame([tuple(map(float, s)) for s in lines], "x1 double, y1 double, x2 double, y2 double")).collect()
    nodes = {(r.ax, r.ay) for r in e} | {(r.bx, r.by) for r in e}
    assert len(got) == len(e) - len(nodes) + 1
    assert areas.agg(F.sum("area")).first()[0] == pytest.approx(100)


def test_polygons_keep_off_the_driver(spark, monkeypatch):
    """No side of a join is sent to the driver, however small it is here."""
    plans, settled = [], planar.settled

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df, *args)

    monkeypatch.setattr(planar, "settled", seen)
    monkeypatch.setattr(blocks, "settled", seen)
    df = spark.createDataFrame([(0.0, 1.0, 9.0, 1.0), (0.0, 5.0, 9.0, 5.0), (2.0, 0.0, 2.0, 6.0), (7.0, 0.0, 7.0, 6.0)], "x1 double, y1 double, x2 double, y2 double")
    found = planar.areas(planar.polygons(df))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert [(r.nodes, r.area) for r in found.collect()] == [(4, 20.0)]
    assert sum("Join" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)


def dense(xs, ys, share, robust):
    """Fits of all rows with all others."""
    order = np.argsort(xs, kind="stable")
    xs, ys = xs[order], ys[order]
    n = len(xs)
    k = min(n, max(2, int(np.ceil(share * n))))
    trust, out = np.ones(n), ys.copy()
    for _ in range(robust + 1):
        for i in range(n):
            d = np.abs(xs - xs[i])
            h = np.partition(d, k - 1)[k - 1]
            w = trust * (np.clip(1 - (d / h) ** 3, 0, None) ** 3 if h > 0 else (d == 0))
            if w.sum() <= 0:
                continue
            mx, my = w @ xs / w.sum(), w @ ys / w.sum()
            v = w @ (xs - mx) ** 2
            out[i] = my + (w @ ((xs - mx) * (ys - my)) / v * (xs[i] - mx) if v > 1e-12 else 0)
        m = 6 * np.median(np.abs(ys - out))
        if m <= 0:
            break
        trust = np.clip(1 - (np.abs(ys - out) / m) ** 2, 0, None) ** 2
    return sorted(zip(xs, ys, out))


def test_lowess(spark):
    draw = np.random.default_rng(1)
    xs = {"a": draw.gamma(2, 3, 3000), "ties": draw.integers(0, 20, 300).astype(float), "one": np.array([3.0]), "two": np.array([3.0, 4.0]), "same": np.full(50, 7.0), None: np.concatenate([draw.uniform(0, 1, 100), draw.uniform(1000, 1001, 60)])}
    rows, want = [], {}
    for s, x in xs.items():
        y = np.sin(x) + draw.normal(0, 0.3, len(x)) + (draw.random(len(x)) < 0.05) * 10
        rows += [(s, float(a), float(b)) for a, b in zip(x, y)]
        want[s] = dense(x, y, 0.3, 2)
    df = spark.createDataFrame([*rows, ("a", None, 1.0), ("a", 1.0, None)], "s string, x double, y double").repartition(4)
    got = {}
    for r in smoothing.lowess(df, "x", "y", ["s"], 0.3, 2).collect():
        got.setdefault(r.s, []).append((r.x, r.y, r.smooth))
    assert set(got) == set(want)
    for s, w in want.items():
        assert np.array(sorted(got[s])) == pytest.approx(np.array(w), abs=1e-9), s


def test_lowess_by_chunks(spark):
    """Windows of a chunk begin and end in many chunks where values jump, in few otherwise; blocks are asked for by chunks, not by values."""
    draw = np.random.default_rng(8)
    x = np.concatenate([draw.uniform(0, 1, 1500), draw.uniform(90, 91, 700), 91 + np.arange(900) ** 2 / 10.0])
    y = np.cos(x) + draw.normal(0, 0.2, len(x))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(3)
    got = sorted(map(tuple, smoothing.lowess(df, "x", "y", [], 0.4, 1).collect()))
    assert np.array(got) == pytest.approx(np.array(dense(x, y, 0.4, 1)), abs=1e-9)
    n = 40_000
    ends = [F.lit(0).cast("long").alias("_s"), F.col("id").alias("q"), F.lit(1.0).alias("h"), F.greatest(F.col("id") - n // 6, F.lit(0)).alias("left"), F.least(F.col("id") + n // 6, F.lit(n - 1)).alias("right")]
    needs = lowess._needs(spark.range(n).select(*ends))
    assert needs.count() < n / 20 and needs.groupBy("_s", "at").count().agg(F.max("count")).first()[0] < 40


def test_tall(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(4000, 3))
    x[:, 1] = x[:, 0] + 1e-9 * x[:, 1]  # a product of columns can't tell these apart
    y = 2 + 3 * x[:, 0] + 1e6 * (x[:, 1] - x[:, 0]) + 0.5 * x[:, 2]
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double").repartition(70)
    fit = tall.least_squares(df, "y", ["a", "b", "c"])
    dense_fit = np.linalg.lstsq(np.column_stack([np.ones(4000), x]), y, rcond=None)[0]
    predicted = np.column_stack([np.ones(4000), x]) @ fit.coef
    assert np.abs(predicted - y).max() < 1e-8 and fit.coef[[0, 3]] == pytest.approx([2, 0.5], abs=1e-8)
    assert fit.coef[1] + fit.coef[2] == pytest.approx(dense_fit[1] + dense_fit[2], abs=1e-7)
    s, v = tall.singular_values(df, ["a", "b", "c"])
    u, s2, _ = np.linalg.svd(x, full_matrices=False)
    assert s == pytest.approx(s2, rel=1e-10, abs=1e-12) and v.T @ v == pytest.approx(np.eye(3), abs=1e-12)
    rows = np.array([(r.u1, r.u2) for r in tall.left_vectors(df, ["a", "b", "c"]).select("u1", "u2").collect()])
    assert rows.T @ rows == pytest.approx(np.eye(2), abs=1e-8)
    assert tall.singular_values(df.limit(0), ["a", "b"])[0] == pytest.approx([0, 0])


def test_normal_distribution_of_several_dimensions(spark):
    bounds = np.array([[0.3, -0.5], [1.0, 2.0], [-3.0, 0.1], [0.0, 0.0]])
    r = np.array([[1, 0.6], [0.6, 1]])
    assert orthants.np_orthant(bounds, r, np.zeros(4)) == pytest.approx(np_bivariate_normal(bounds[:, 0], bounds[:, 1], np.full(4, 0.6)), abs=1e-5)
    for m in (1, 2, 3, 4, 5):  # of equal correlations of a half, at 0
        got = orthants.np_orthant(np.zeros((3, m)), np.full((m, m), 0.5) + 0.5 * np.eye(m), np.array([0.1, 0.5, 0.9]))
        assert got == pytest.approx(np.full(3, 1 / (m + 1)), rel=0.005)
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (None, 0.0, 1.0), (1.0, 1.0, 9.0)], "a double, b double, c double")
    got = [x.p for x in df.select(orthants.multivariate_normal(["a", "b", "c"], np.eye(3)).alias("p")).collect()]
    assert got[0] == pytest.approx(1 / 8, abs=1e-6) and got[1] is None and got[2] == pytest.approx(0.8413447**2, abs=1e-5)
    assert np.isnan(orthants.np_orthant(np.zeros((1, 2)), np.array([[1.0, 2.0], [2.0, 1.0]]), np.zeros(1))).all()


def test_simultaneous_probit(spark):
    draw = np.random.default_rng(5)
    n = 1500
    x = draw.normal(size=n).round(1)
    e = draw.multivariate_normal([0, 0], [[1, 0.5], [0.5, 1]], n)
    rows = [(float(v), int(0.3 + 0.8 * v + a > 0), int(-0.2 - 0.5 * v + b > 0)) for v, (a, b) in zip(x, e)]
    df = spark.createDataFrame([*rows, (None, 1, 0)], "x double, a int, b int")
    fit = orthants.simultaneous_probit(df, [("a", ["x"]), ("b", ["x"])])
    assert fit.converged and np.abs(fit.coef - [0.3, 0.8, -0.2, -0.5, 0.5]).max() < 0.15
    assert (np.abs(fit.coef - [0.3, 0.8, -0.2, -0.5, 0.5]) < 3.5 * fit.se).all()
    apart = orthants.simultaneous_probit(df, [("a", ["x"]), ("b", ["x"])], correlated=[])
    single = [regression.probit(df, y, ["x"]) for y in "ab"]
    assert apart.coef == pytest.approx(np.concatenate([s.coef for s in single]), abs=1e-4)
    assert apart.se == pytest.approx(np.concatenate([s.se for s in single]), rel=1e-3)
    assert apart.loglik == pytest.approx(sum(s.loglik for s in single), abs=1e-4) and fit.loglik > apart.loglik


def test_multinomial_probit(spark):
    draw = np.random.default_rng(5)
    n = 600
    x, z = draw.normal(size=n).round(1), draw.normal(size=(n, 3)).round(1)
    e = draw.multivariate_normal([0, 0, 0], [[1, 0, 0], [0, 1, 0.6], [0, 0.6, 1]], n)
    use = np.column_stack([np.zeros(n), 0.4 + 0.7 * x, -0.3 - 0.4 * x]) + 0.8 * z + e
    df = spark.createDataFrame([(float(v), int(k) + 1, *map(float, w)) for v, k, w in zip(x, use.argmax(1), z)], "x double, y int, z1 double, z2 double, z3 double")
    fit = orthants.multinomial_probit(df, "y", ["x"], [1, 2, 3], [(1, 2)], {"z": ["z1", "z2", "z3"]})
    assert fit.names == ["2:constant", "2:x", "3:constant", "3:x", "z", "correlation_1_2"] and fit.converged
    assert (np.abs(fit.coef - [0.4, 0.7, -0.3, -0.4, 0.8, 0.6]) < 3.5 * fit.se).all()
    # of two categories it is a probit of half the variance
    two = df.where("y < 3")
    fit = orthants.multinomial_probit(two, "y", ["x"], [1, 2])
    one = regression.probit(two.withColumn("y", F.col("y") - 1), "y", ["x"])
    assert fit.coef == pytest.approx(one.coef * np.sqrt(2), abs=1e-4) and fit.loglik == pytest.approx(one.loglik, abs=1e-5)


def test_correspondence(spark):
    n = np.random.default_rng(4).poisson(3, (40, 9)) * 1.0
    n[0], n[:, 0] = n[0] + 40, n[:, 0] * 5
    cells = [(i, f"c{j}", float(v)) for (i, j), v in np.ndenumerate(n)] + [(None, "c1", 5.0), (3, None, 5.0)]
    values, inertia, rows, columns = correspondence.correspondence(spark.createDataFrame(cells, "i long, j string, n double"), 3)
    p = n / n.sum()
    r, c = p.sum(1), p.sum(0)
    u, s, v = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)))
    assert values == pytest.approx(s[:3], abs=1e-8) and inertia == pytest.approx((s**2).sum())
    got = np.array([[x[f"d{k + 1}"] for k in range(3)] for x in sorted(rows.collect())])
    assert np.abs(got) == pytest.approx(np.abs(u[:, :3] * s[:3] / np.sqrt(r)[:, None]), abs=1e-3)
    got = np.array([[x[f"d{k + 1}"] for k in range(3)] for x in sorted(columns.collect())])
    assert np.abs(got) == pytest.approx(np.abs(v[:3].T * s[:3] / np.sqrt(c)[:, None]), abs=1e-3)


def empty_circles(p):
    """All triangles of p with no other point in their circle."""
    three = np.array(list(itertools.combinations(range(len(p)), 3)))
    a, b, c = (p[three[:, k]] for k in range(3))
    side = lambda b, c: (b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]
    turned = (side(b, c) > 0)[:, None]
    b, c = np.where(turned, b, c), np.where(turned, c, b)
    ok = side(b, c) != 0
    for k in range(len(p)):
        inside = np.linalg.det(np.stack([np.column_stack([q - p[k], ((q - p[k]) ** 2).sum(1)]) for q in (a, b, c)], 1)) > 0
        ok &= ~(inside & (three != k).all(1))
    return {tuple(sorted(map(tuple, p[t]))) for t in three[ok]}


@pytest.mark.parametrize("kind", ["even", "clustered", "ring"])
def test_triangles(spark, kind):
    draw = np.random.default_rng(6)
    turn = np.arange(40)
    p = {
        "even": draw.random((80, 2)), "clustered": np.concatenate([draw.random((40, 2)) / 1000, draw.random((40, 2)) * [1, 30]]),
        "ring": np.column_stack([np.cos(turn), np.sin(turn)]) * (1 + draw.random((40, 1)) / 10),
    }[kind]
    df = spark.createDataFrame([*(tuple(map(float, r)) for r in [*p, *p[:5]]), (None, 1.0), (float("inf"), 1.0)], "x double, y double")
    want = empty_circles(p)
    for per_cell in (6, 1000):  # the same for any number of cells
        found = delaunay.triangles(df, per_cell=per_cell).collect()
        assert {tuple(sorted([(r.ax, r.ay), (r.bx, r.by), (r.cx, r.cy)])) for r in found} == want and len(found) == len(want)
        assert all((r.bx - r.ax) * (r.cy - r.ay) > (r.by - r.ay) * (r.cx - r.ax) and (r.ax, r.ay) < min((r.bx, r.by), (r.cx, r.cy)) for r in found)
    corners = delaunay.voronoi(spark.createDataFrame(found)).collect()
    for r in corners:
        far = np.sort(((p - [r.vx, r.vy]) ** 2).sum(1))
        assert ((r.x - r.vx) ** 2 + (r.y - r.vy) ** 2, far[2]) == pytest.approx((far[0], far[0]), rel=1e-6)


def test_triangles_of_many_points_and_of_cells_with_few(spark):
    """Points of a cell are taken in without a look at all triangles, and a cell of few points still finds all of its triangles."""
    p = np.random.default_rng(6).uniform(0, 100, (3000, 2))
    start = time.perf_counter()
    t = delaunay._triangulated(p)
    assert time.perf_counter() - start < 2  # some 6 s if every point meets all triangles
    inner = t[t[:, 2] >= 0]
    assert len(inner) == 2 * len(p) - 2 - (len(t) - len(inner))  # Euler
    for k in range(0, len(inner), 37):
        assert (delaunay._within(*p[inner[k]], np.delete(p, inner[k], 0)) < 0).all()
    few = p[:160]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in few], "x double, y double")
    want = {tuple(sorted(map(tuple, few[c].tolist()))) for c in delaunay._triangulated(few) if c[2] >= 0}
    got = [tuple(sorted([(r.ax, r.ay), (r.bx, r.by), (r.cx, r.cy)])) for r in delaunay.triangles(df, per_cell=2).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_triangles_of_a_grid_and_of_a_line(spark):
    """Four points on a circle everywhere: some triangulation of the square, the same for any cells."""
    df = spark.range(36).select((F.col("id") % 6).alias("x"), F.floor(F.col("id") / 6).alias("y"))
    got = [sorted(map(tuple, delaunay.triangles(df, per_cell=n).collect())) for n in (5, 100)]
    flat = lambda t: abs((t[2] - t[0]) * (t[5] - t[1]) - (t[3] - t[1]) * (t[4] - t[0]))
    solid = [[t for t in g if flat(t) > 0] for g in got]
    assert solid[0] == solid[1] and len(solid[0]) == 50 and sum(map(flat, solid[0])) == 50
    line = spark.range(9).select(F.col("id").alias("x"), F.lit(2).alias("y"))
    assert all(flat(t) == 0 for t in map(tuple, delaunay.triangles(line).collect())) and delaunay.triangles(line.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [5, 200_000])
def test_spanning_forest_by_chunks(spark, monkeypatch, chunk):
    """Chunks of any size give the one forest whose edges come first by value and ends; its trees are taken whole, and so fit in few jobs."""
    monkeypatch.setattr(graphs, "CHUNK", chunk)
    r = np.random.default_rng(4)
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in np.concatenate([r.integers(0, 300, (300, 2)), r.integers(1000, 1040, (200, 2))]) if a != b}
    rows = [(a, b, float((a * 7 + b * 13) % 11)) for a, b in sorted(pairs)]
    for largest in (False, True):
        up, want = {}, set()

        def root(x, up=up):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b, v in sorted(rows, key=lambda e: (-e[2] if largest else e[2], e[0], e[1])):
            if root(a) != root(b):
                up[root(a)] = root(b)
                want.add((a, b, v))
        got = graphs.spanning_tree(spark.createDataFrame(rows, "i long, j long, v double"), largest)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert graphs.spanning_tree(spark.createDataFrame([], "i long, j long, v double")).count() == 0
    links = np.array([(a, b) for a, b, _ in rows])
    of, _ = zip(*[(n, c) for n, c in graphs.components(spark.createDataFrame(rows, "i long, j long, v double")).collect()])
    assert sorted(of) == sorted(set(links.ravel().tolist()))


def test_links_of_a_chunk():
    f = pd.DataFrame({"u": [5, 9, 7, 3], "v": [2, 7, 5, 1]})
    out = pd.concat(graphs._stars(iter([f])))
    assert sorted(map(tuple, out.to_numpy().tolist())) == [(3, 1), (5, 2), (7, 2), (9, 2)]


def test_cliques_of_large_numbers(spark):
    """Nodes that a double can't hold, and a node's rows in several batches."""
    n = 2**53 + 1
    e = [(n, n + 2), (n, n + 4), (n + 2, n + 4), (n + 4, n + 6), (1, 2)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = blocks.cliques(spark.createDataFrame([(*x, 1.0) for x in e], "i long, j long, v double")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(list(r.clique) for r in got) == [[1, 2], [n, n + 2, n + 4], [n + 4, n + 6]]


def test_degrees_of_edges_that_are_dealt_out(spark, monkeypatch):
    """Edges whose number is known are merged by tasks of a given size, which Spark doesn't put together; one reading of them gives both ends."""
    monkeypatch.setattr(graphs, "PAIRS", 50)
    df = spark.range(500).select((F.col("id") % 30).cast("int").alias("i"), (F.col("id") * 7 % 40).alias("j"), F.lit(2).alias("v"))
    e = graphs.define(df, v="v", rows=500)
    assert e.rdd.getNumPartitions() == 10 and sorted(map(tuple, e.collect())) == sorted(map(tuple, graphs.define(df, v="v").collect()))
    pairs = {(k % 30, k * 7 % 40) for k in range(500)}
    want = {n: (sum(i == n for i, _ in pairs), sum(j == n for _, j in pairs), int(all(i == j for i, j in pairs if n in (i, j)))) for p in pairs for n in p}
    got = graphs.degrees(e)
    assert got._jdf.queryExecution().executedPlan().toString().count("Range") == 1
    assert {r.node: (r.out_degree, r.in_degree, r.isolated) for r in got.collect()} == want

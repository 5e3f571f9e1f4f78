"""Delaunay triangles and Voronoi cells of any number of points, cell by cell.

Points are cut into strips and cells of about equal numbers. A cell triangulates its own points with the nearer ones of the cells around; each triangle at a point
of its own, and each edge of the outline, then goes to all cells that its circle (or the side beyond the edge) touches, which name a point of theirs
inside, if they have one. Cells that are told of points take them in and go on; when none is told of any, all triangles stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import dealt, settled
from ..plans.ordered import bucket_of, cuts

#: Points of a cell, and cells at most: their bounds, a number each, go with every task.
CELL, CELLS = 150, 2**20
#: Points are moved by up to this part of the extent, by a hash of them: four on one circle then have one triangulation, the same in every cell.
MOVED = 1e-9
#: A cell takes in the points around it up to this part of its neighbour's width or height; more where it is told of them.
MARGIN = 0.4
_BEYOND = -1


def _side(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Positive where p is left of a to b."""
    return (b[..., 0] - a[..., 0]) * (p[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (p[..., 0] - a[..., 0])


def _within(a: np.ndarray, b: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Positive where p is in the circle of the anticlockwise triangle a, b, c."""
    a, b, c = a - p, b - p, c - p
    square = lambda v: (v * v).sum(-1)
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    return square(a) * cross(b, c) + square(b) * cross(c, a) + square(c) * cross(a, b)


def _turns(p: np.ndarray) -> np.ndarray:
    """An order of points in which each is near the one before and every part of a doubling sequence is spread over all."""
    order, out, end = np.random.default_rng(1).permutation(len(p)), [], len(p)
    place = (p - p.min(0)) / np.maximum(np.ptp(p, 0), 1e-300)
    while end > 0:
        begin = end // 2 if end > 16 else 0
        part = order[begin:end]
        rows = np.floor(place[part, 1] * np.sqrt(len(part) / 2))
        out.append(part[np.lexsort((np.where(rows % 2 == 0, 1, -1) * place[part, 0], rows))])
        end = begin
    return np.concatenate(out[::-1]) if out else order


def _triangulated(p: np.ndarray) -> np.ndarray:
    """Triangles (rows of three places) of points, among them (u, v, -1) for each edge of the outline, which has no point to its left. Points are taken in one by one:
    from the last triangle made, a walk leads to the one that a point falls into; what about it has the point in its circle goes, and the edges around the gap are
    joined with the point. None if all are on a line."""
    start = [0, 1, *np.flatnonzero(np.abs(_side(p[0], p[1], p)) > 0)[:1].tolist()] if len(p) > 2 else []
    if len(start) < 3:
        return np.zeros((0, 3), np.int64)
    a, b, c = start if _side(p[start[0]], p[start[1]], p[start[2]]) > 0 else (start[1], start[0], start[2])
    xs, ys = p[:, 0].tolist(), p[:, 1].tolist()
    apex: dict[tuple[int, int], int] = {}  # of the triangle to the left of an edge

    def put(u, v, w):
        apex[u, v], apex[v, w], apex[w, u] = w, u, v

    def side(u, v, x, y):
        return (xs[v] - xs[u]) * (y - ys[u]) - (ys[v] - ys[u]) * (x - xs[u])

    def hit(u, v, w, x, y):
        if w == _BEYOND:
            return side(u, v, x, y) > 0
        if u == _BEYOND:
            return side(v, w, x, y) > 0
        if v == _BEYOND:
            return side(w, u, x, y) > 0
        ux, uy, vx, vy, wx, wy = xs[u] - x, ys[u] - y, xs[v] - x, ys[v] - y, xs[w] - x, ys[w] - y
        return (ux * ux + uy * uy) * (vx * wy - vy * wx) + (vx * vx + vy * vy) * (wx * uy - wy * ux) + (wx * wx + wy * wy) * (ux * vy - uy * vx) > 0

    for t in ((a, b, c), (b, a, _BEYOND), (c, b, _BEYOND), (a, c, _BEYOND)):
        put(*t)
    for k in _turns(p).tolist():
        if k in start:
            continue
        x, y = xs[k], ys[k]
        for _ in range(4 * len(p)):
            if side(a, b, x, y) < 0:
                b, a = a, b
            elif side(b, c, x, y) < 0:
                a, b = c, b
            elif side(c, a, x, y) < 0:
                a, b = a, c
            else:
                break
            c = apex[a, b]
            if c == _BEYOND:
                break
        if not hit(a, b, c, x, y):  # on a corner or an edge: any triangle that has the point in its circle
            a, b, c = next(((u, v, w) for (u, v), w in apex.items() if hit(u, v, w, x, y)), (None, None, None))
            if a is None:
                a, b, c = next((u, v, w) for (u, v), w in apex.items() if min(u, v, w) >= 0)
                continue
        del apex[a, b], apex[b, c], apex[c, a]
        open_, free = [(a, b), (b, c), (c, a)], []
        while open_:
            u, v = open_.pop()
            w = apex.get((v, u))
            if w is None:
                continue  # both sides are gone
            if hit(v, u, w, x, y):
                del apex[v, u], apex[u, w], apex[w, v]
                open_ += [(u, w), (w, v)]
            else:
                free.append((u, v))
        for u, v in free:
            put(u, v, k)
            if u != _BEYOND and v != _BEYOND:
                a, b, c = u, v, k
    return np.array([(u, v, w) for (u, v), w in apex.items() if w == _BEYOND or (0 <= u < v and u < w)], np.int64)


def triangles(points: DataFrame, x: str = "x", y: str = "y", per_cell: int = CELL, rounds: int = 100) -> DataFrame:
    """ax, ay, bx, by, cx, cy: the Delaunay triangles of the distinct points, each from its smallest point (by x, then y), anticlockwise.

    Rows with nulls or values that aren't finite are left out. Where four points or more are on one circle, which of the possible triangles
    are given depends on the points alone. Points on one line have none.
    """
    spark = points.sparkSession
    p = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna().where("abs(x) < double('inf') AND abs(y) < double('inf')").distinct()
    p = settled(p)
    one = p.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{c}") for k, f in (("lo", F.min), ("hi", F.max)) for c in "xy"]).first()
    shape = "ax double, ay double, bx double, by double, cx double, cy double"
    if one.n < 3:
        return spark.createDataFrame([], shape)
    extent = max(one.hix - one.lox, one.hiy - one.loy)
    sides = max(1, int(np.ceil(np.sqrt(min(CELLS, one.n / per_cell)))))
    moved = lambda c, seed, low: (F.col(c) - low + F.xxhash64("x", "y", F.lit(seed)) / 2.0**63 * MOVED * extent).alias(f"p{c}")
    p = p.select("x", "y", moved("x", 1, one.lox), moved("y", 2, one.loy))
    x_ends = np.array(cuts(p, F.col("px"), sides))
    p = settled(p.withColumn("strip", bucket_of(F.col("px"), list(x_ends))))
    shares = [k / sides for k in range(1, sides)]
    y_ends = {r.strip: np.array(sorted(set(r.ends))) for r in p.groupBy("strip").agg(F.percentile_approx("py", shares, 20 * sides).alias("ends")).collect()} if shares else {}
    y_ends = [y_ends.get(s, np.zeros(0)) for s in range(len(x_ends) + 1)]
    borders = np.concatenate([[-np.inf], x_ends, [np.inf]])
    width, box = sides + 1, 2 * extent + 1
    # cells are few bytes and much work: the number of their partitions is given, so that none are put together
    tasks = max(1, min(one.n // per_cell, max(2 * spark.sparkContext.defaultParallelism, one.n // (64 * per_cell))))

    def around(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each point for its cell and for those about it that it is near."""
        low, high = np.clip(borders[:-1], 0, extent), np.clip(borders[1:], 0, extent)
        for f in frames:
            out, strip, px, py = [], f["strip"].to_numpy(), f["px"].to_numpy(), f["py"].to_numpy()
            reach = MARGIN * (high - low)[strip]
            for by, far in ((-1, px - low[strip]), (0, 0.0), (1, high[strip] - px)):
                s = strip + by
                ok = (s >= 0) & (s < len(y_ends)) & (far <= reach)
                for t in np.unique(s[ok]):
                    g, y = f[ok & (s == t)], py[ok & (s == t)]
                    row = np.searchsorted(y_ends[t], y)
                    lows, highs = np.concatenate([[0.0], y_ends[t]])[row], np.concatenate([y_ends[t], [extent]])[row]
                    for up, away in ((-1, y - lows), (0, 0.0), (1, highs - y)):
                        r = row + up
                        use = (r >= 0) & (r <= len(y_ends[t])) & (away <= MARGIN * (highs - lows))
                        out.append(g[use].assign(cell=t * width + r[use], own=by == 0 and up == 0))
            yield pd.concat(out)[["cell", "own", "x", "y", "px", "py"]]

    kind = "cell long, own boolean, x double, y double, px double, py double"
    held = settled(p.mapInPandas(around, kind))
    own = settled(held.where("own"))
    corner = [f"{k}{c}" for k in "abc" for c in ("x", "y", "px", "py")]
    told = "cell long, outer boolean, mine boolean, " + ", ".join(f"{c} double" for c in corner)

    def local(f: pd.DataFrame) -> pd.DataFrame:
        f = f.drop_duplicates(["x", "y"]).sort_values(["x", "y"], ignore_index=True)
        at, mine = f[["px", "py"]].to_numpy(), f["own"].to_numpy()
        t = _triangulated(at)
        if not len(t) and mine.any():  # too few points for a triangle: the cell asks for points on either side of one of its own
            x, y, px, py = f.loc[mine.argmax(), ["x", "y", "px", "py"]]
            a, b = (x, y, px, py), (x, y, px, py + extent)
            return pd.DataFrame([(f["cell"].iloc[0], True, False, *u, *v, *u) for u, v in ((a, b), (b, a))], columns=["cell", "outer", "mine", *corner])
        real = np.where(t == _BEYOND, t[:, :1], t)
        t, real = t[mine[real].any(1)], real[mine[real].any(1)]
        first = real.argmin(1)
        real = np.where((t[:, 2] == _BEYOND)[:, None], real, np.take_along_axis(real, (first[:, None] + np.arange(3)) % 3, 1))
        rows = f[["x", "y", "px", "py"]].to_numpy()[real].reshape(len(real), -1)
        out = pd.DataFrame(rows, columns=corner)
        out.insert(0, "cell", f["cell"].iloc[0])
        out.insert(1, "outer", t[:, 2] == _BEYOND)
        out.insert(2, "mine", mine[real[:, 0]] & (t[:, 2] != _BEYOND))
        return out

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each triangle or outer edge for the cells in which a point of theirs could be inside."""
        for f in frames:
            a, b, c = (f[[f"{k}px", f"{k}py"]].to_numpy() for k in "abc")
            d = 2 * _side(a, b, c)
            u, v = b - a, c - a
            with np.errstate(all="ignore"):
                mid = a + np.column_stack([v[:, 1] * (u * u).sum(1) - u[:, 1] * (v * v).sum(1), u[:, 0] * (v * v).sum(1) - v[:, 0] * (u * u).sum(1)]) / d[:, None]
                r = np.sqrt(((mid - a) ** 2).sum(1)) * (1 + 1e-9)
            out, everything = [], f
            outer = f["outer"].to_numpy()
            begin = np.where(outer, 0, np.searchsorted(x_ends, mid[:, 0] - r))
            end = np.where(outer, len(x_ends), np.searchsorted(x_ends, mid[:, 0] + r, "right"))
            all_ = a, u, mid, r, outer
            for s in range(begin.min(initial=0), end.max(initial=-1) + 1):
                here = np.flatnonzero((begin <= s) & (s <= end))
                if not len(here):
                    continue
                f, (a, u, mid, r, outer) = everything.iloc[here], (z[here] for z in all_)
                left, right = max(borders[s], -1.0), min(borders[s + 1], box)
                with np.errstate(all="ignore"):
                    near = np.clip(mid[:, 0], left, right) - mid[:, 0]
                    half = np.sqrt(r * r - near * near)
                    # beyond a to b: to its left
                    edge = [a[:, 1] + (e - a[:, 0]) * u[:, 1] / u[:, 0] for e in (left, right)]
                low = np.where(outer, np.where(u[:, 0] > 0, np.fmin(*edge), -np.inf), mid[:, 1] - half)
                high = np.where(outer, np.where(u[:, 0] < 0, np.fmax(*edge), np.inf), mid[:, 1] + half)
                touch = np.flatnonzero((low <= high) & (outer | (np.abs(near) <= r)))
                first, last = np.searchsorted(y_ends[s], low[touch] - 1e-9 * extent), np.searchsorted(y_ends[s], high[touch] + 1e-9 * extent)
                many = last - first + 1
                g = f.iloc[np.repeat(touch, many)]
                rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
                out.append(g.assign(to=s * width + rows))
            if out:
                yield pd.concat(out)[["to", *everything.columns]]

    def inside(mine: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or f.empty:
            return pd.DataFrame({"cell": [], "own": [], "x": [], "y": [], "px": [], "py": []}).astype({"cell": "int64", "own": bool})
        p_ = mine[["px", "py"]].to_numpy()
        a, b, c = (f[[f"{k}px", f"{k}py"]].to_numpy() for k in "abc")
        picked = []
        for begin in range(0, len(f), 500):
            part = slice(begin, begin + 500)
            deep = np.where(f["outer"].to_numpy()[part, None], _side(a[part, None], b[part, None], p_[None]), _within(a[part, None], b[part, None], c[part, None], p_[None]))
            for k in (a, b, c):  # corners aren't inside
                deep[(k[part, None] == p_[None]).all(-1)] = -1
            best = deep.argmax(1)
            ok = deep[np.arange(len(best)), best] > 0
            picked.append(pd.DataFrame({"cell": f["cell"].to_numpy()[part][ok], "at": best[ok]}))
        new = pd.concat(picked).drop_duplicates()
        return mine.iloc[new["at"]][["x", "y", "px", "py"]].assign(cell=new["cell"].to_numpy(), own=False)[["cell", "own", "x", "y", "px", "py"]]

    final = None
    active = held
    for _ in range(rounds):
        found = settled(active.repartition(tasks, "cell").groupBy("cell").applyInPandas(local, told))
        to = found.mapInPandas(asked, "to long, " + told)
        more = (own.repartition(tasks, "cell").groupBy("cell").cogroup(to.repartition(tasks, "to").groupBy("to")).applyInPandas(inside, kind).distinct())
        more = settled(more.join(dealt(active.select("cell", "x", "y")), ["cell", "x", "y"], "left_anti").select(*held.columns))  # rounding may name a point that is held already
        again = more.select("cell").distinct()
        done = found.join(again, "cell", "left_anti").where("mine")
        final = done if final is None else final.unionByName(done)
        if more.isEmpty():
            return final.select("ax", "ay", "bx", "by", "cx", "cy")
        active = settled(active.join(again, "cell", "left_semi").unionByName(more))
    raise RuntimeError("the triangles did not settle")


def voronoi(found: DataFrame) -> DataFrame:
    """x, y, place, vx, vy: the corners of each point's Voronoi cell, anticlockwise, from Delaunay triangles; points on the outline have no bounded cell and are left out."""
    bx, by, cx, cy = (F.col(k) - F.col(f"a{k[1]}") for k in ("bx", "by", "cx", "cy"))
    d = 2 * (bx * cy - by * cx)
    ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    t = found.withColumns({"vx": F.col("ax") + ux, "vy": F.col("ay") + uy})
    turn = [("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")]
    ends = F.explode(F.array(*[F.struct(*[F.col(f"{p}{k}").alias(f"{n}{k}") for n, p in zip(("p", "q", "r"), o) for k in "xy"]) for o in turn])).alias("e")
    t = t.select("vx", "vy", ends).select("vx", "vy", "e.*")
    # a star is closed if each neighbour that a triangle begins with is the last of another
    open_ = t.select("px", "py", F.col("qx").alias("x"), F.col("qy").alias("y"), F.lit(1).alias("w")).unionByName(t.select("px", "py", F.col("rx").alias("x"), F.col("ry").alias("y"), F.lit(-1).alias("w")))
    open_ = open_.groupBy("px", "py", "x", "y").agg(F.sum("w").alias("w")).where("w <> 0").select("px", "py").distinct()
    # triangles in the order of their first neighbour's angle
    w = Window.partitionBy("px", "py").orderBy(F.atan2(F.col("qy") - F.col("py"), F.col("qx") - F.col("px")))
    out = t.join(open_, ["px", "py"], "left_anti").withColumn("place", F.row_number().over(w) - 1)
    return out.select(F.col("px").alias("x"), F.col("py").alias("y"), "place", "vx", "vy")

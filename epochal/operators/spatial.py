"""Points, lines and polygons: an object is a row with an array of (x, y) structs, closed implicitly for polygons."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPE = "array<struct<x:double,y:double>>"


def gathered(rows: DataFrame, id: str, order: str, x: str, y: str) -> DataFrame:
    """Objects from a row for each vertex: id, shape."""
    got = rows.groupBy(F.col(id).alias("id")).agg(F.array_sort(F.collect_list(F.struct(order, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("_v"))
    return got.select("id", F.transform("_v", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).cast(SHAPE).alias("shape"))


def vertices(df: DataFrame, shape: str = "shape") -> DataFrame:
    return df.select("id", F.posexplode(shape).alias("place", "_v")).select("id", "place", "_v.x", "_v.y")


def _edges(shape: Column, closed: bool) -> Column:
    """Pairs (a, b) of consecutive vertices."""
    n = F.size(shape)
    last = n - 1 if closed else n - 2
    pair = lambda i: F.struct(F.get(shape, i).alias("a"), F.get(shape, F.when(i + 1 < n, i + 1).otherwise(0)).alias("b"))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), pair)).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))


def signed_area(shape: str = "shape") -> Column:
    """Positive where the vertices run anticlockwise."""
    return 0.5 * F.aggregate(_edges(F.col(shape), True), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])


def length(shape: str = "shape", closed: bool = False) -> Column:
    d2 = lambda e: (e["b"]["x"] - e["a"]["x"]) * (e["b"]["x"] - e["a"]["x"]) + (e["b"]["y"] - e["a"]["y"]) * (e["b"]["y"] - e["a"]["y"])
    return F.aggregate(_edges(F.col(shape), closed), F.lit(0.0), lambda s, e: s + F.sqrt(d2(e)))


def box(shape: str = "shape") -> dict[str, Column]:
    x, y = F.transform(shape, lambda v: v["x"]), F.transform(shape, lambda v: v["y"])
    return {"xmin": F.array_min(x), "xmax": F.array_max(x), "ymin": F.array_min(y), "ymax": F.array_max(y)}


def information(df: DataFrame) -> DataFrame:
    """id, vertices, area, perimeter, clockwise, and the enclosing rectangle."""
    area = signed_area()
    return df.select("id", F.size("shape").alias("vertices"), F.abs(area).alias("area"), length(closed=True).alias("perimeter"), F.when(area < 0, 1).otherwise(0).alias("clockwise"), *[c.alias(k) for k, c in box().items()])


def inside(x: Column, y: Column, shape: Column) -> Column:
    """Whether a point is in a polygon; its boundary belongs to it."""
    edges = _edges(shape, True)
    between = lambda p, a, b: (p >= F.least(a, b)) & (p <= F.greatest(a, b))
    cross = lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])
    on = F.exists(edges, lambda e: (F.abs(cross(e)) <= 1e-12) & between(x, e["a"]["x"], e["b"]["x"]) & between(y, e["a"]["y"], e["b"]["y"]))
    hits = F.filter(edges, lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return on | (F.size(hits) % 2 == 1)


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))


def _grid(polygons: DataFrame, cells: int) -> float:
    """A width of grid cells of which an average polygon covers about cells squared."""
    b = box()
    mean = polygons.agg(F.avg(F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"]))).first()[0]
    return (mean or 1.0) / cells


def points_in_polygons(points: DataFrame, polygons: DataFrame, cells: int = 2) -> DataFrame:
    """point, polygon for every point in a polygon. points: id, x, y. Both sides meet by the cells of a grid, so that only near pairs are tested."""
    g, b = _grid(polygons, cells), box()
    p = points.select(F.col("id").alias("point"), "x", "y", F.floor(F.col("x") / g).cast("long").alias("_gx"), F.floor(F.col("y") / g).cast("long").alias("_gy"))
    q = polygons.select(F.col("id").alias("polygon"), "shape", *[c.alias(k) for k, c in b.items()])
    q = q.withColumn("_gx", F.explode(_cells(F.col("xmin"), F.col("xmax"), g))).withColumn("_gy", F.explode(_cells(F.col("ymin"), F.col("ymax"), g)))
    near = p.join(q, ["_gx", "_gy"]).where((F.col("x") >= F.col("xmin")) & (F.col("x") <= F.col("xmax")) & (F.col("y") >= F.col("ymin")) & (F.col("y") <= F.col("ymax")))
    return near.where(inside(F.col("x"), F.col("y"), F.col("shape"))).select("point", "polygon")


def _crossing(s: Column, t: Column) -> Column:
    """Whether any edge of line or polygon s properly crosses an edge of polygon t."""
    side = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
    return F.exists(s, lambda e: F.exists(t, lambda f: (side(e["a"], e["b"], f["a"]) * side(e["a"], e["b"], f["b"]) < 0) & (side(f["a"], f["b"], e["a"]) * side(f["a"], f["b"], e["b"]) < 0)))


def contained(objects: DataFrame, polygons: DataFrame, closed: bool = False, cells: int = 2) -> DataFrame:
    """object, polygon: lines (or, closed, polygons) that lie in a polygon as a whole. Candidates meet by the grid cell of the first vertex."""
    g, b = _grid(polygons, cells), box()
    o = objects.select(F.col("id").alias("object"), F.col("shape").alias("_own"), F.get("shape", F.lit(0)).alias("_v"), *[c.alias(f"o_{k}") for k, c in b.items()])
    o = o.withColumns({"_gx": F.floor(F.col("_v.x") / g).cast("long"), "_gy": F.floor(F.col("_v.y") / g).cast("long")})
    q = polygons.select(F.col("id").alias("polygon"), "shape", *[c.alias(k) for k, c in b.items()])
    q = q.withColumn("_gx", F.explode(_cells(F.col("xmin"), F.col("xmax"), g))).withColumn("_gy", F.explode(_cells(F.col("ymin"), F.col("ymax"), g)))
    near = o.join(q, ["_gx", "_gy"]).where("o_xmin >= xmin and o_xmax <= xmax and o_ymin >= ymin and o_ymax <= ymax")
    near = near.where(F.forall("_own", lambda v: inside(v["x"], v["y"], F.col("shape")))).where(~_crossing(_edges(F.col("_own"), closed), _edges(F.col("shape"), True)))
    return near.select("object", "polygon")


def inclusion(polygons: DataFrame) -> DataFrame:
    """inner, outer: polygons inside others."""
    return contained(polygons, polygons, closed=True).where("object <> polygon").select(F.col("object").alias("inner"), F.col("polygon").alias("outer"))


def segments(df: DataFrame, closed: bool = False) -> DataFrame:
    """id, place, x1, y1, x2, y2 of every edge."""
    return df.select("id", F.posexplode(_edges(F.col("shape"), closed)).alias("place", "_e")).select("id", "place", F.col("_e.a.x").alias("x1"), F.col("_e.a.y").alias("y1"), F.col("_e.b.x").alias("x2"), F.col("_e.b.y").alias("y2"))


def hulls(df: DataFrame) -> DataFrame:
    """id and the convex hull of each object's vertices, anticlockwise."""

    def run(frames):
        for f in frames:
            out = []
            for shape in f["shape"]:
                pts = sorted({(v["x"], v["y"]) for v in shape})
                if len(pts) > 2:
                    halves = []
                    for line in (pts, pts[::-1]):
                        h: list[tuple[float, float]] = []
                        for p in line:
                            while len(h) > 1 and (h[-1][0] - h[-2][0]) * (p[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (p[0] - h[-2][0]) <= 0:
                                h.pop()
                            h.append(p)
                        halves += h[:-1]
                    pts = halves
                out.append([{"x": x, "y": y} for x, y in pts])
            yield pd.DataFrame({"id": f["id"], "shape": out})

    kind = dict(df.dtypes)["id"]
    return df.select("id", "shape").mapInPandas(run, f"id {kind}, shape {SHAPE}")


def clipped(df: DataFrame, rectangle: tuple[float, float, float, float]) -> DataFrame:
    """Polygons cut to a rectangle (xmin, ymin, xmax, ymax); those outside are left out. Side after side, edges are cut in built-in array functions."""
    xmin, ymin, xmax, ymax = (float(v) for v in rectangle)

    of = lambda v, side: F.when(side["axis"] == "x", v["x"]).otherwise(v["y"])
    ok = lambda v, side: F.when(side["above"], of(v, side) >= side["limit"]).otherwise(of(v, side) <= side["limit"])

    def piece(e: Column, side: Column) -> Column:
        a, b = e["a"], e["b"]
        t = (side["limit"] - of(a, side)) / (of(b, side) - of(a, side))
        meet = F.struct(F.when(side["axis"] == "x", side["limit"]).otherwise(a["x"] + t * (b["x"] - a["x"])).alias("x"), F.when(side["axis"] == "y", side["limit"]).otherwise(a["y"] + t * (b["y"] - a["y"])).alias("y"))
        return F.when(ok(a, side) & ok(b, side), F.array(b)).when(ok(a, side), F.array(meet)).when(ok(b, side), F.array(meet, b)).otherwise(F.array().cast(SHAPE))

    sides = F.array(*[F.struct(F.lit(x).alias("axis"), F.lit(v).alias("limit"), F.lit(up).alias("above")) for x, v, up in (("x", xmin, True), ("x", xmax, False), ("y", ymin, True), ("y", ymax, False))])
    # a fold, so that each side is cut once from what the one before left
    cut = lambda shape, side: F.flatten(F.transform(_edges(shape, True), lambda e: piece(e, side))).cast(SHAPE)
    df = df.withColumn("shape", F.aggregate(sides, F.col("shape").cast(SHAPE), cut))
    return df.where(F.size("shape") > 2)


def network(lines: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x, y) at the ends of lines, rounded to tolerance, and edges (i, j, v: length)."""
    snap = lambda v: F.struct(F.round(v["x"] / tolerance).cast("long").alias("x"), F.round(v["y"] / tolerance).cast("long").alias("y"))
    ends = lines.select("id", snap(F.get("shape", F.lit(0))).alias("a"), snap(F.element_at("shape", -1)).alias("b"), length().alias("v"))
    node = lambda s: F.xxhash64(F.col(f"{s}.x"), F.col(f"{s}.y"))
    edges = ends.select(node("a").alias("i"), node("b").alias("j"), "v")
    nodes = ends.select(F.col("a").alias("p")).union(ends.select("b")).distinct().select(F.xxhash64("p.x", "p.y").alias("node"), (F.col("p.x") * tolerance).alias("x"), (F.col("p.y") * tolerance).alias("y"))
    return nodes, edges


def projected(lon: Column, lat: Column, kind: str, center: tuple[float, float] = (0.0, 0.0)) -> tuple[Column, Column]:
    """x and y on the unit sphere: mercator, cylindrical, sinusoidal, orthographic, stereographic, azimuthal (equal area), from degrees."""
    lam, phi, phi0 = F.radians(lon - center[0]), F.radians(lat), float(np.radians(center[1]))
    if kind == "mercator":
        return lam, F.log(F.tan(phi / 2 + np.pi / 4))
    if kind == "cylindrical":
        return lam, F.sin(phi)
    if kind == "sinusoidal":
        return lam * F.cos(phi), phi
    cosc = np.sin(phi0) * F.sin(phi) + np.cos(phi0) * F.cos(phi) * F.cos(lam)
    k = {"orthographic": F.lit(1.0), "stereographic": 2 / (1 + cosc), "azimuthal": F.sqrt(2 / (1 + cosc))}[kind]
    return k * F.cos(phi) * F.sin(lam), k * (np.cos(phi0) * F.sin(phi) - np.sin(phi0) * F.cos(phi) * F.cos(lam))


def selected(df: DataFrame, rectangle: Sequence[float]) -> DataFrame:
    """Objects whose enclosing rectangle meets another."""
    b = box()
    return df.where((b["xmax"] >= rectangle[0]) & (b["ymax"] >= rectangle[1]) & (b["xmin"] <= rectangle[2]) & (b["ymin"] <= rectangle[3]))

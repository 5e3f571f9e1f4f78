"""Polygons from line segments: crossings, half-edges and faces.

Segments are cut where they meet; each piece becomes two half-edges. The half-edge that follows another around a face is told by
the order of angles at their common node, and faces are the cycles of that permutation. All steps are joins and small windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import dealt, discard, settled
from .blocks import ranked

#: The edges of a node are dealt into so many sectors, whose ends are linked: a node of many edges is no single group.
SECTORS = 64


def _cells(size: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The cells (cx, cy) of a grid of that size that the box of a segment touches."""
    along = lambda a, b: F.sequence(F.floor(F.least(a, b) / size).cast("long"), F.floor(F.greatest(a, b) / size).cast("long"))
    xs, ys = along(x1, x2), along(y1, y2)
    return F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def meetings(segments: DataFrame, tol: float = 1e-9) -> DataFrame:
    """id, t: where on each segment (0 its start, 1 its end) another one meets it, ends included. segments: id, x1, y1, x2, y2.

    A segment lies in a grid of cells about as long as itself, where a few hold it; it looks for longer ones in their grids, which are
    as many as there are doublings between the shortest and the longest. So neither long segments nor clusters of short ones meet all others.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    level = F.ceil(F.log2(F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(tol)))).cast("int")
    s = settled(segments.withColumn("level", level))
    levels = [F.lit(r.level) for r in s.select("level").distinct().collect()]  # exponents of doubles: some 2,000 at most
    if not levels:
        return s.select("id", F.lit(0.0).alias("t")).limit(0)
    size = F.pow(F.lit(2.0), F.col("at"))
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    held = s.withColumn("at", F.col("level")).select("*", F.explode(_cells(size, *box)).alias("c")).select("*", "c.cx", "c.cy").drop("c")
    longer = F.explode(F.filter(F.array(*levels), lambda at: at >= F.col("level")))
    asks = s.select("*", longer.alias("at")).select("*", F.explode(_cells(size, *box)).alias("c")).select("*", "c.cx", "c.cy").drop("c", "level")
    two = {c: f"b_{c}" for c in ("id", "x1", "y1", "x2", "y2")}
    other = held.select("at", "cx", "cy", "level", *[F.col(c).alias(n) for c, n in two.items()])
    pairs = asks.join(dealt(other), ["at", "cx", "cy"]).where(F.col("id") != F.col("b_id"))
    overlap = lambda u: (F.least(f"{u}1", f"{u}2") <= F.greatest(f"b_{u}1", f"b_{u}2") + tol) & (F.least(f"b_{u}1", f"b_{u}2") <= F.greatest(f"{u}1", f"{u}2") + tol)
    pairs = pairs.where(overlap("x") & overlap("y"))
    ax, ay = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    bx, by = F.col("b_x2") - F.col("b_x1"), F.col("b_y2") - F.col("b_y1")
    ox, oy = F.col("b_x1") - F.col("x1"), F.col("b_y1") - F.col("y1")
    cross, la, lb = ax * by - ay * bx, F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    t, u = (ox * by - oy * bx) / cross, (ox * ay - oy * ax) / cross
    inside = lambda x, length: (x * length >= -tol) & ((x - 1) * length <= tol)
    on = F.abs(cross) > 1e-12 * la * lb
    crossing = F.when(on & inside(t, la) & inside(u, lb), F.array(F.struct(F.col("id"), t.alias("t")), F.struct(F.col("b_id").alias("id"), u.alias("t"))))
    # parallel ones meet if they lie on one line; then the ends of each are places on the other

    def end(of: str, px: Column, py: Column, qx: Column, qy: Column, length: Column) -> Column:
        at = (px * qx + py * qy) / (length * length)
        return F.when(inside(at, length), F.struct(F.col(of).alias("id"), at.alias("t")))

    far = F.abs(ox * ay - oy * ax) / la
    ends = F.array(
        end("id", ox, oy, ax, ay, la), end("id", ox + bx, oy + by, ax, ay, la),
        end("b_id", -ox, -oy, bx, by, lb), end("b_id", ax - ox, ay - oy, bx, by, lb),
    )
    along = F.when(~on & (far <= tol), F.filter(ends, lambda x: x.isNotNull()))
    return pairs.select(F.explode(F.coalesce(crossing, along)).alias("m")).select("m.id", F.least(F.greatest("m.t", F.lit(0.0)), F.lit(1.0)).alias("t")).distinct()


def pieces(segments: DataFrame, x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2", tol: float = 1e-6) -> DataFrame:
    """Distinct pieces ax, ay, bx, by of segments cut wherever they meet. Ends that round to the same multiple of tol are one node, at the mean of its
    points; pieces between equal nodes count once, those within a node are dropped, as are segments with a null or without length."""
    s = segments.select(*[F.col(c).cast("double").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))]).dropna().where("x1 <> x2 OR y1 <> y2").distinct()
    s = settled(s.withColumn("id", F.monotonically_increasing_id()))
    ends = s.select("id", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    cuts = meetings(s, tol / 2).unionByName(ends).distinct()
    along = Window.partitionBy("id").orderBy("t")
    cuts = cuts.withColumn("next", F.lead("t").over(along)).where("next IS NOT NULL").join(dealt(s), "id")
    at = lambda t, a, b: F.col(a) + F.col(t) * (F.col(b) - F.col(a))
    cuts = cuts.select(at("t", "x1", "x2").alias("ax"), at("t", "y1", "y2").alias("ay"), at("next", "x1", "x2").alias("bx"), at("next", "y1", "y2").alias("by"))
    key = lambda c: F.round(F.col(c) / tol).cast("long").alias(f"k{c}")
    cuts = settled(cuts.select("*", *[key(c) for c in ("ax", "ay", "bx", "by")]))
    points = cuts.select(F.col("kax").alias("kx"), F.col("kay").alias("ky"), F.col("ax").alias("x"), F.col("ay").alias("y")).union(cuts.select("kbx", "kby", "bx", "by"))
    where = points.groupBy("kx", "ky").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    a, b = (F.struct(F.col(f"k{n}x").alias("x"), F.col(f"k{n}y").alias("y")) for n in "ab")
    e = cuts.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    of = lambda n: dealt(where.select(F.struct(F.col("kx").alias("x"), F.col("ky").alias("y")).alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")))
    return e.join(of("a"), "a").join(of("b"), "b").select("ax", "ay", "bx", "by")


def _followed(half: DataFrame) -> DataFrame:
    """h and the half-edge that comes next on the face to its left. half: h (a piece's two are 2 k and 2 k + 1), u, v (nodes), angle from u.

    Next of u to v is the edge from v that comes before v to u in the order of angles."""
    out = half.select("h", "u", "angle", F.floor((F.col("angle") + 3.2) / 6.4 * SECTORS).alias("sector"))
    inside, along = Window.partitionBy("u", "sector").orderBy("angle", "h"), Window.partitionBy("u").orderBy("sector")
    order = F.struct("angle", "h")
    ends = out.groupBy("u", "sector").agg(F.min(order)["h"].alias("h"), F.max(order)["h"].alias("tail"))
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    links = ends.select("h", F.coalesce(F.lag("tail").over(along), F.last("tail").over(whole)).alias("over"))
    before = out.withColumn("before", F.lag("h").over(inside)).join(dealt(links), "h", "left").select("h", F.coalesce("before", "over").alias("before"))
    flip = F.when(F.col("h") % 2 == 0, F.col("h") + 1).otherwise(F.col("h") - 1)
    return before.select(flip.alias("h"), F.col("before").alias("next"))


def cycles_of(following: DataFrame, a: str = "h", b: str = "next") -> DataFrame:
    """a and cycle, the smallest element of the cycle of a permutation a to b that it is on. Each round looks twice as far; kept as a table."""
    now = settled(following.select(F.col(a).alias("a"), F.col(b).alias("b"), F.least(a, b).alias("m"), F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        to = now.select(F.col("a").alias("b"), F.col("b").alias("_b"), F.col("m").alias("_m"))
        now = settled(now.join(dealt(to), "b").select("a", F.col("_b").alias("b"), F.least("m", "_m").alias("m"), (F.col("_m") < F.col("m")).alias("moved")), now)
    return now.select(F.col("a").alias(a), F.col("m").alias("cycle"))


def faces(edges: DataFrame) -> DataFrame:
    """polygon, place, x, y: the nodes of every bounded face of a plane graph, anticlockwise from its smallest node (by x, then y). edges: ax, ay, bx, by, which
    meet only in nodes. Edges with one face on both sides are left out first, so that no polygon has a loose end. A part inside a face of another
    makes no hole in it."""
    e = edges.select(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")).alias("a"), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")).alias("b"))
    names = e.select(F.explode(F.array("a", "b")).alias("p")).distinct()
    names = settled(names.withColumn("node", F.monotonically_increasing_id()))
    of = lambda n: dealt(names.select(F.col("p").alias(n), F.col("node").alias(f"n{n}")))
    e = settled(e.join(of("a"), "a").join(of("b"), "b").withColumn("h", F.monotonically_increasing_id()))
    one = lambda h, a, b: e.select(h.alias("h"), F.col(f"n{a}").alias("u"), F.col(f"n{b}").alias("v"), F.col(a).alias("p"), F.atan2(F.col(f"{b}.y") - F.col(f"{a}.y"), F.col(f"{b}.x") - F.col(f"{a}.x")).alias("angle"), F.col(b).alias("q"))
    half = settled(one(F.col("h") * 2, "a", "b").unionByName(one(F.col("h") * 2 + 1, "b", "a")))
    first = cycles_of(_followed(half))
    both = first.groupBy(F.floor(F.col("h") / 2).alias("k")).agg(F.min("cycle").alias("one"), F.max("cycle").alias("other"))
    kept = settled(half.withColumn("k", F.floor(F.col("h") / 2)).join(dealt(both.where("one <> other").select("k")), "k", "left_semi").drop("k"))
    follow = settled(_followed(kept))
    around = kept.join(dealt(cycles_of(follow)), "h")
    # the area about a point of the face itself: coordinates far from 0 lose no digits
    corner = around.groupBy("cycle").agg(F.min(F.struct(F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("h"))).alias("low"))
    placed = settled(around.join(dealt(corner), "cycle"))
    x = lambda c: F.col(f"{c}.x") - F.col("low.x")
    y = lambda c: F.col(f"{c}.y") - F.col("low.y")
    area = F.sum(x("p") * y("q") - y("p") * x("q")) / 2
    inner = placed.groupBy("cycle").agg(area.alias("area"), F.count("*").alias("n")).where("area > 0")
    placed = placed.join(dealt(inner), "cycle")
    lists = placed.join(dealt(follow), "h").select(F.col("h").alias("a"), F.when(F.col("next") != F.col("low.h"), F.col("next")).alias("b"))
    rank = ranked(lists).select(F.col("a").alias("h"), "rank")
    out = placed.join(dealt(rank), "h").select(F.col("cycle").alias("polygon"), (F.col("n") - 1 - F.col("rank")).alias("place"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    out = settled(out)
    for t in (half, kept, follow, placed):
        discard(t)
    return out


def polygons(segments: DataFrame, x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2", tol: float = 1e-6) -> DataFrame:
    """The polygons that line segments enclose: polygon, place, x, y."""
    return faces(pieces(segments, x1, y1, x2, y2, tol))


def areas(found: DataFrame) -> DataFrame:
    """polygon, nodes, area and the box of polygons given as polygon, place, x, y."""
    low = found.groupBy("polygon").agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"), F.count("*").alias("nodes"))
    p = found.join(dealt(low), "polygon").select("*", (F.col("x") - F.col("x_min")).alias("u"), (F.col("y") - F.col("y_min")).alias("v"))
    after = p.select("polygon", ((F.col("place") + F.col("nodes") - 1) % F.col("nodes")).alias("place"), F.col("u").alias("_u"), F.col("v").alias("_v"))
    both = p.join(dealt(after), ["polygon", "place"])
    return both.groupBy("polygon").agg(F.max("nodes").alias("nodes"), (F.sum(F.col("u") * F.col("_v") - F.col("v") * F.col("_u")) / 2).alias("area"), *[F.max(c).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")])

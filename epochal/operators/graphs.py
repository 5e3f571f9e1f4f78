"""Graphs as edge lists: i, j and a value v. Iterations write each round's table to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import discard, settled

#: Edges that a task looks at together.
CHUNK = 200_000
#: Rows of which a task merges pairs, where their number is known.
PAIRS = 500_000


def define(edges: DataFrame, i: str = "i", j: str = "j", v: str | None = None, directed: bool = True, merge: str = "sum", least: float | None = None, rows: int | None = None) -> DataFrame:
    """Edges i, j, v, one for each pair (undirected: i <= j), values of repeated ones merged by min, max or sum; those below least are dropped.

    rows: how many edges there are, if known and few are of the same pair. They are then dealt out before they are merged, to as many tasks as they need:
    a first merge where they are read would only hold them all, and Spark puts partitions together by their bytes, not by what merging them takes."""
    value = F.lit(1.0) if v is None else F.col(v).cast("double")
    e = edges.select(F.col(i).alias("i"), F.col(j).alias("j"), value.alias("v")).dropna(subset=["i", "j"])
    if least is not None:
        e = e.where(F.col("v") >= least)
    if not directed:
        e = e.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "v")
    if rows is not None:
        e = e.repartition(max(1, -(-rows // PAIRS)), "i", "j")
    if v is None:
        return e.distinct()
    return e.groupBy("i", "j").agg({"min": F.min, "max": F.max, "sum": F.sum}[merge]("v").alias("v"))


def from_matrix(df: DataFrame, row: str, columns: Sequence[str], least: float | None = None) -> DataFrame:
    """Edges from an adjacency matrix with a column for each node, named in the order of nodes from 1; v is at least least (None: isn't 0)."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("j"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns, 1)])).alias("_x")
    e = df.select(F.col(row).cast("long").alias("i"), cells).select("i", "_x.j", "_x.v")
    return e.where(F.col("v") >= least if least is not None else F.col("v") != 0)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("i", "j", "v").unionByName(edges.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("i").alias("node")).union(edges.select("j")).distinct()


def union(a: DataFrame, b: DataFrame, missing: float = -1.0) -> DataFrame:
    """The full outer join of two edge lists: i, j, v1, v2."""
    left, right = a.select("i", "j", F.col("v").alias("v1")), b.select("i", "j", F.col("v").alias("v2"))
    return left.join(right, ["i", "j"], "full_outer").withColumns({c: F.coalesce(c, F.lit(missing)) for c in ("v1", "v2")})


def aggregated(edges: DataFrame, mapping: DataFrame, directed: bool = True) -> DataFrame:
    """Edges between groups of nodes; mapping: node, to. Values are summed; a node that isn't mapped stays."""
    m = mapping.select(F.col("node").alias("_n"), F.col("to").alias("_to"))
    e = edges.join(m, F.col("i") == F.col("_n"), "left").select(F.coalesce("_to", "i").alias("i"), "j", "v")
    e = e.join(m, F.col("j") == F.col("_n"), "left").select("i", F.coalesce("_to", "j").alias("j"), "v")
    if not directed:
        e = e.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "v")
    return e.groupBy("i", "j").agg(F.sum("v").alias("v"))


def degrees(edges: DataFrame, all_nodes: DataFrame | None = None) -> DataFrame:
    """node, out_degree, in_degree, isolated (no edge but to itself)."""
    end = lambda c, o, n: F.struct(F.col(c).alias("node"), F.lit(o).alias("o"), F.lit(n).alias("n"))
    ends = edges.select(F.when(F.col("i") != F.col("j"), 1).otherwise(0).alias("x"), F.explode(F.array(end("i", 1, 0), end("j", 0, 1))).alias("e")).select("e.*", "x")  # both from one reading of the edges
    got = ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("n").alias("in_degree"), F.sum("x").alias("_x"))
    if all_nodes is not None:
        got = all_nodes.select("node").join(got, "node", "left")
    return got.select("node", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.when(F.coalesce("_x", F.lit(0)) == 0, 1).otherwise(0).alias("isolated"))


def link_lists(edges: DataFrame, backward: bool = False) -> DataFrame:
    """node and the sorted array of its successors (or predecessors)."""
    a, b = ("j", "i") if backward else ("i", "j")
    return edges.groupBy(F.col(a).alias("node")).agg(F.array_sort(F.collect_set(b)).alias("links"))


def asymmetric(edges: DataFrame) -> DataFrame:
    """Edges without an equal one the other way; none: the graph is symmetric."""
    back = edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return edges.select("i", "j", "v").join(back, ["i", "j", "v"], "left_anti")


def _tri(edges: DataFrame) -> DataFrame:
    """Triangles a, b, c of an undirected graph. Each edge points to its end of the higher degree, so that no node points to many."""
    e = edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    deg = e.select(F.col("i").alias("node")).unionAll(e.select("j")).groupBy("node").agg(F.count("*").alias("d"))
    e = e.join(deg.select(F.col("node").alias("i"), F.col("d").alias("di")), "i").join(deg.select(F.col("node").alias("j"), F.col("d").alias("dj")), "j")
    first = F.struct("di", "i") < F.struct("dj", "j")
    e = e.select(F.when(first, F.col("i")).otherwise(F.col("j")).alias("a"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("b"))
    two = e.alias("x").join(e.alias("y"), (F.col("x.a") == F.col("y.a")) & (F.col("x.b") < F.col("y.b"))).select(F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("y.b").alias("c"))
    ends = e.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"))
    return two.join(ends, ["b", "c"], "left_semi")


def neighbourhoods(edges: DataFrame) -> DataFrame:
    """Of an undirected graph: node, size (with the node itself), edges inside, density 2 edges / (size (size - 1))."""
    e = edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    deg = e.select(F.col("i").alias("node")).unionAll(e.select("j")).groupBy("node").agg(F.count("*").alias("d"))
    tri = _tri(edges).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    out = deg.join(tri, "node", "left").select("node", (F.col("d") + 1).alias("size"), (F.col("d") + F.coalesce("t", F.lit(0))).alias("edges"))
    return out.withColumn("density", 2 * F.col("edges") / (F.col("size") * (F.col("size") - 1)))


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Which of the edges a to b between nodes below n join two parts, taken in turn, and the smallest node of each node's part."""
    up, taken = list(range(n)), []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
            taken.append(k)
    for x in range(n):  # a node's next one up is smaller
        up[x] = up[up[x]]
    return taken, up


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for f in frames:
        held.append(f)
        size += len(f)
        if size >= CHUNK:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges u, v of a chunk as links of its nodes to the smallest one that they reach in it."""
    for f in _chunks(frames):
        names, codes = np.unique(f[["u", "v"]].to_numpy().ravel(), return_inverse=True)
        _, up = _joined(codes[::2], codes[1::2], len(names))
        out = pd.DataFrame({"u": names, "v": names[up]})
        yield out[out["u"] != out["v"]]


def _without_worst(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges i, j, v of a chunk but those that are the last, by v, i and j, of a cycle in it: no least forest of the whole holds them."""
    for f in _chunks(frames):
        if f["v"].isna().any():
            yield f
            continue
        f = f.sort_values(["v", "i", "j"], ignore_index=True)
        names, codes = np.unique(f[["i", "j"]].to_numpy().ravel(), return_inverse=True)
        yield f.iloc[_joined(codes[::2], codes[1::2], len(names))[0]]


def _near(e: DataFrame, by: str) -> DataFrame:
    """e, a table, with rows of near values of by together."""
    return e.repartitionByRange(by).sortWithinPartitions(by)


def _whole_numbers(e: DataFrame, *names: str) -> bool:
    return all(dict(e.dtypes)[c] in ("int", "bigint") for c in names)


def components(edges: DataFrame, all_nodes: DataFrame | None = None, rounds: int = 100) -> DataFrame:
    """node and component: the smallest node connected with it, whatever the edges' directions.

    Where nodes are whole numbers, tasks first link the nodes of chunks of edges to the smallest ones there: graphs whose near nodes
    have near numbers are then nearly done, and what no other chunk shares a node with is left alone. Rounds of two rewritings: a node links its larger neighbours to its smallest one, then its smaller neighbours and itself to
    the smallest. Edges stay as many as they were at most; when nothing changes, each node is linked to its root.
    """
    e = edges.where("i <> j").select(F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v"))
    if _whole_numbers(e, "u", "v"):
        e = settled(e)
        e = settled(_near(e, "v").mapInPandas(_stars, e.schema), e)
        marks = e.select("u", "v").union(e.select("v", "v"))
        shared = marks.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").select("u")
        open_ = settled(marks.join(shared, "u", "left_semi").select("v").distinct())
        done = e.join(open_, "v", "left_anti").select("u", "v")
        e = settled(e.join(open_, "v", "left_semi").select("u", "v").distinct())
    else:
        done, e = None, settled(e.distinct())

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    was = signature(e)
    for _ in range(rounds):
        if not was[0]:
            break
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        e = settled(instead_of=e, df=small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", "m")).where("u <> v").distinct())
        now = signature(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    named = (e if done is None else e.unionByName(done.distinct())).select(F.col("u").alias("node"), F.col("v").alias("component"))
    every = nodes(edges) if all_nodes is None else all_nodes.select("node")
    return every.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def distances(edges: DataFrame, sources: DataFrame, directed: bool = True, weighted: bool = True, most: int = 1000) -> DataFrame:
    """source, node, distance of the shortest paths from each of sources (node); values must not be negative. Rounds relax only from nodes that got nearer."""
    e = (edges if directed else both_ways(edges)).select("i", "j", (F.col("v") if weighted else F.lit(1.0)).cast("double").alias("v"))
    e = settled(e.groupBy("i", "j").agg(F.min("v").alias("v")))
    best = settled(sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance")).distinct())
    last = front = best
    for _ in range(most):
        step = front.join(e, front.node == e.i).groupBy("source", F.col("j").alias("node")).agg(F.min(F.col("distance") + F.col("v")).alias("_d"))
        both = best.join(step, ["source", "node"], "full_outer")
        both = settled(both.select("source", "node", F.least("distance", "_d").alias("distance"), (F.col("distance").isNull() | (F.col("_d") < F.col("distance"))).alias("_new")), last)
        last = both
        best, front = both.drop("_new"), both.where("_new").drop("_new")
        if front.isEmpty():
            return best
    raise RuntimeError("distances did not settle")


def reachable(edges: DataFrame, sources: DataFrame, directed: bool = True) -> DataFrame:
    """source, node, steps."""
    return distances(edges, sources, directed, weighted=False).select("source", "node", F.col("distance").cast("int").alias("steps"))


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """i, j, steps of all pairs joined by a directed path of one edge or more; paths double in each round. The result may hold every pair."""
    e = settled(edges.select("i", "j").distinct().withColumn("steps", F.lit(1)))
    n = e.count()
    for _ in range(rounds):
        longer = e.alias("x").join(e.alias("y"), F.col("x.j") == F.col("y.i")).select(F.col("x.i"), F.col("y.j"), (F.col("x.steps") + F.col("y.steps")).alias("steps"))
        e2 = settled(e.union(longer).groupBy("i", "j").agg(F.min("steps").alias("steps")))
        now = e2.agg(F.count("*"), F.sum("steps")).first()
        same = (now[0], now[1]) == (n, e.agg(F.sum("steps")).first()[0])
        discard(e)
        e, n = e2, now[0]
        if same:
            return e
    raise RuntimeError("closure did not settle")


def strong_components(edges: DataFrame) -> DataFrame:
    """node and component: the smallest node that it reaches and that reaches it.

    Each node takes the smallest node that reaches it as its colour. What reaches that node inside its colour is a
    component, whose smallest node it is; the rest goes on with the edges inside colours.
    """
    left = settled(nodes(edges).select("node"))
    e = settled(edges.where("i <> j").select("i", "j").distinct())
    found = None
    while not left.isEmpty():
        colour = _spread(left.withColumn("c", F.col("node")), e)
        of = lambda side, name: colour.select(F.col("node").alias(side), F.col("c").alias(name))  # noqa: E731, B023
        e = settled(e.join(of("i", "_a"), "i").join(of("j", "_b"), "j").where("_a = _b").select("i", "j"), e)
        # backwards from each colour's own node; other nodes begin with no label, the largest of all
        marked = colour.select("node", F.when(F.col("node") == F.col("c"), F.col("c")).alias("c"))
        part = _spread(marked, e.select(F.col("j").alias("i"), F.col("i").alias("j"))).where("c is not null")
        found = part if found is None else found.union(part)
        rest = settled(left.join(part.select("node"), "node", "left_anti"), left)
        e = settled(e.join(rest.withColumnRenamed("node", "i"), "i", "left_semi").join(rest.withColumnRenamed("node", "j"), "j", "left_semi"), e)
        left = rest
    if found is None:
        return nodes(edges).withColumn("component", F.col("node"))
    return found.select("node", F.col("c").alias("component"))


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """node and c: the smallest label (nulls don't count) of all nodes from which a path leads to it, its own included."""
    now = settled(labels.select("node", "c", F.col("c").isNotNull().alias("_new")))
    while not now.where("_new").isEmpty():
        sent = edges.join(now.where("_new").select(F.col("node").alias("i"), "c"), "i").groupBy(F.col("j").alias("node")).agg(F.min("c").alias("_c"))
        both = now.join(sent, "node", "left").select("node", F.least("c", "_c").alias("c"), F.coalesce(F.col("_c") < F.col("c"), F.col("_c").isNotNull() & F.col("c").isNull()).alias("_new"))
        now = settled(both, now)
    return now.select("node", "c")


def topological(edges: DataFrame, most: int = 10_000) -> DataFrame:
    """node and level: 0 without predecessors, else one above the highest predecessor. Nodes on or behind a directed cycle have a null level."""
    e, all_ = settled(edges.where("i <> j").select("i", "j").distinct()), settled(nodes(edges))
    loops = edges.where("i = j").select(F.col("i").alias("node")).distinct()
    done, left = None, settled(all_.join(loops, "node", "left_anti"))
    for level in range(most):
        free = settled(left.join(e.select(F.col("j").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        done = free if done is None else done.union(free)
        left = settled(left.join(free, "node", "left_anti"), left)
        e = settled(e.join(free.select(F.col("node").alias("i")), "i", "left_anti"), e)
    if done is None:
        return all_.withColumn("level", F.lit(None).cast("int"))
    return all_.join(done, "node", "left")


def spanning_tree(edges: DataFrame, largest: bool = False) -> DataFrame:
    """The edges i, j, v of a minimum (or maximum) spanning forest of an undirected graph: in each round every part takes its best edge
    outwards, ties going to the smaller ends, and the parts so joined become one.

    Tasks first leave out the worst edge of each cycle in a chunk of edges (nodes whole numbers, values doubles); components that are trees then
    are taken whole, and only the others go through rounds.
    """
    e = settled(edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), (-F.col("v") if largest else F.col("v")).alias("v")).groupBy("i", "j").agg(F.min("v").alias("v")))
    if _whole_numbers(e, "i", "j") and dict(e.dtypes)["v"] == "double":
        e = settled(_near(e, "i").mapInPandas(_without_worst, e.schema), e)
    part = components(e).select(F.col("node").alias("i"), F.col("component").alias("part"))
    named = settled(part.join(e, "i", "left"))  # a row for each node without an edge, or for each of its edges
    size = named.groupBy("part").agg(F.count_distinct("i").alias("nodes"), F.count("j").alias("edges"))
    size = settled(size.select("part", (F.col("edges") < F.col("nodes")).alias("tree")))
    named = named.where("j IS NOT NULL").join(size, "part")
    taken = settled(named.where("tree").select("i", "j", "v"))
    e = settled(named.where("NOT tree").select("i", "j", "v", F.col("i").alias("a"), F.col("j").alias("b")))
    while not e.isEmpty():
        ends = e.select(F.col("a").alias("p"), F.struct("v", "i", "j", "a", "b").alias("x")).union(e.select(F.col("b"), F.struct("v", "i", "j", "a", "b")))
        best = settled(ends.groupBy("p").agg(F.min("x").alias("x")).select("x.*").distinct())
        taken = taken.union(best.select("i", "j", "v"))
        parts = components(best.select(F.col("a").alias("i"), F.col("b").alias("j"), "v"))
        joined = e.join(parts.select(F.col("node").alias("a"), F.col("component").alias("_a")), "a", "left").join(parts.select(F.col("node").alias("b"), F.col("component").alias("_b")), "b", "left")
        e = settled(joined.select("i", "j", "v", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b"), e)
    return taken.distinct().select("i", "j", (-F.col("v") if largest else F.col("v")).alias("v"))


def paths(edges: DataFrame, longest: int, cycles: bool = False) -> DataFrame:
    """Directed paths of up to longest edges without a repeated node: nodes (array), length, value (sum). With cycles, the cycles, each once, from its
    smallest node. Their number may grow with the power of the degree: meant for small graphs or short paths."""
    e = settled(edges.where("i <> j").select("i", "j", "v"))
    now = e.select(F.array("i", "j").alias("nodes"), F.lit(1).alias("length"), F.col("v").cast("double").alias("value"))
    if cycles:
        now = now.where(F.col("nodes")[0] < F.col("nodes")[1])
    out, closed = now, None
    for _ in range(longest - 1):
        step = now.join(e, F.element_at("nodes", -1) == F.col("i"))
        if cycles:
            back = step.where(F.col("j") == F.col("nodes")[0]).select(F.col("nodes"), (F.col("length") + 1).alias("length"), (F.col("value") + F.col("v")).alias("value"))
            closed = back if closed is None else closed.union(back)
            step = step.where(F.col("j") > F.col("nodes")[0])
        now = settled(step.where(~F.array_contains("nodes", F.col("j"))).select(F.concat("nodes", F.array("j")).alias("nodes"), (F.col("length") + 1).alias("length"), (F.col("value") + F.col("v")).alias("value")))
        out = out.union(now)
    if not cycles:
        return out
    return closed if closed is not None else out.limit(0)


def common_neighbours(edges: DataFrame, most_links: int | None = None) -> DataFrame:
    """a, b, common, share (of the union) for every two nodes with a neighbour in common. Nodes that share one hub are all paired; most_links leaves
    hubs of more links out, and the result then tells only of the others."""
    e = both_ways(edges.where("i <> j")).select("i", "j").distinct()
    deg = e.groupBy("i").agg(F.count("*").alias("d"))
    via = e if most_links is None else e.join(deg.where(F.col("d") <= most_links).select(F.col("i").alias("j")), "j", "left_semi")
    two = via.alias("x").join(via.alias("y"), (F.col("x.j") == F.col("y.j")) & (F.col("x.i") < F.col("y.i"))).groupBy(F.col("x.i").alias("a"), F.col("y.i").alias("b")).agg(F.count("*").alias("common"))
    two = two.join(deg.select(F.col("i").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("i").alias("b"), F.col("d").alias("db")), "b")
    return two.select("a", "b", "common", (F.col("common") / (F.col("da") + F.col("db") - F.col("common"))).alias("share"))


def leading_eigenvector(edges: DataFrame, rounds: int = 100, eps: float = 1e-9, directed: bool = False) -> tuple[float, DataFrame]:
    """The largest eigenvalue of the adjacency matrix and its vector (node, value; length 1) by power steps on the matrix plus the identity."""
    e = settled(edges if directed else both_ways(edges))
    x = settled(nodes(edges).withColumn("value", F.lit(1.0)))
    value = 0.0
    for k in range(rounds):
        y = e.join(x, e.j == x.node).groupBy("i").agg(F.sum(F.col("v") * F.col("value")).alias("_y"))
        y = x.join(y, x.node == y.i, "left").select("node", (F.col("value") + F.coalesce("_y", F.lit(0.0))).alias("value"))
        norm = y.agg(F.sqrt(F.sum(F.col("value") * F.col("value")))).first()[0]
        if not norm:
            return 0.0, x
        y = y.withColumn("value", F.col("value") / norm)
        x = settled(y, x)
        new = norm - 1
        if k and abs(new - value) <= eps * (1 + abs(new)):
            return new, x
        value = new
    return value, x


def integrated(edges: DataFrame, eps: float = 1e-9, rounds: int = 200) -> DataFrame:
    """i, j, v: the sum of all powers of the edges' matrix, which counts direct and indirect shares; entries below eps are dropped on the way."""
    a = settled(edges.groupBy("i", "j").agg(F.sum("v").alias("v")))
    power = total = a
    for k in range(rounds):
        power = settled(instead_of=power if k else None, df=power.select("i", F.col("j").alias("k"), F.col("v").alias("p")).join(a.select(F.col("i").alias("k"), "j", "v"), "k").groupBy("i", "j").agg(F.sum(F.col("p") * F.col("v")).alias("v")).where(F.abs("v") >= eps))
        if power.isEmpty():
            return total
        total = settled(total.union(power).groupBy("i", "j").agg(F.sum("v").alias("v")), total if k else None)
    raise RuntimeError("the powers don't vanish")


def levels(edges: DataFrame, root: Column | float) -> DataFrame:
    """node, parent, level of a tree, or of the breadth-first tree, from its root."""
    spark = edges.sparkSession
    source = spark.range(1).select((root if isinstance(root, Column) else F.lit(root)).cast(edges.schema["i"].dataType).alias("node"))
    d = settled(distances(edges, source, weighted=False).select("node", F.col("distance").cast("int").alias("level")))
    up = edges.join(d.select(F.col("node").alias("i"), F.col("level").alias("_u")), "i").join(d.select(F.col("node").alias("j"), F.col("level").alias("_v")), "j").where("_v = _u + 1")
    parent = up.groupBy(F.col("j").alias("node")).agg(F.min("i").alias("parent"))
    return d.join(parent, "node", "left").select("node", "parent", "level")


def permutation_cycles(df: DataFrame, i: str, p: str) -> DataFrame:
    """cycle (its smallest element), length, of the permutation i to p."""
    e = df.select(F.col(i).alias("i"), F.col(p).alias("j"), F.lit(1.0).alias("v"))
    return components(e).groupBy(F.col("component").alias("cycle")).agg(F.count("*").alias("length"))


def by_time(edges: DataFrame, time: str) -> DataFrame:
    """Temporal edges: time, edges, nodes, and the mean and largest out-degree at each time."""
    e = edges.groupBy(time, "i").agg(F.count("*").alias("d"))
    ends = edges.select(time, F.col("i").alias("n")).union(edges.select(time, "j")).distinct().groupBy(time).agg(F.count("*").alias("nodes"))
    return e.groupBy(time).agg(F.sum("d").alias("edges"), F.avg("d").alias("mean_out_degree"), F.max("d").alias("max_out_degree")).join(ends, time)


def degree_distribution(edges: DataFrame, time: str | None = None, incoming: bool = False) -> DataFrame:
    """time, degree, nodes."""
    keys = [time] if time else []
    d = edges.groupBy(*keys, "j" if incoming else "i").agg(F.count("*").alias("degree"))
    return d.groupBy(*keys, "degree").agg(F.count("*").alias("nodes"))


def complete(spark: SparkSession, n: int, directed: bool = False) -> DataFrame:
    """All edges between nodes 1 to n."""
    i = spark.range(1, n + 1).withColumnRenamed("id", "i")
    to = F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")) if directed else F.when(F.col("i") < n, F.sequence(F.col("i") + 1, F.lit(n).cast("long")))
    return i.select("i", F.explode(to).alias("j")).where("i <> j").withColumn("v", F.lit(1.0))


def random(spark: SparkSession, n: int, m: int, directed: bool = False, seed: int = 1) -> DataFrame:
    """About m distinct edges (draws that repeat or are loops are dropped) between nodes 1 to n, alike on every run."""
    draw = lambda s: 1 + F.pmod(F.xxhash64(F.lit(seed), F.lit(s), "id"), F.lit(n))
    return define(spark.range(m).select(draw(1).alias("i"), draw(2).alias("j")).where("i <> j"), directed=directed)


def hasse(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The covering relation of distinct patterns ordered by every column: lower and upper (arrays), without what follows by transitivity. Every two
    distinct patterns are compared."""
    p = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("p")).distinct()
    below = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: x <= y), lambda t: t) & (a != b)
    less = p.select(F.col("p").alias("a")).join(p.select(F.col("p").alias("b")), below(F.col("a"), F.col("b")))
    less = settled(less)
    through = less.alias("x").join(less.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b")).distinct()
    return less.join(through, ["a", "b"], "left_anti").select(F.col("a").alias("lower"), F.col("b").alias("upper"))


def dot(edges: DataFrame, directed: bool = True) -> DataFrame:
    """Lines of the dot language: one value column."""
    arrow = " -> " if directed else " -- "
    body = edges.select(F.lit(1).alias("_o"), F.concat(F.lit("  "), F.col("i").cast("string"), F.lit(arrow), F.col("j").cast("string"), F.lit(";")).alias("value"))
    spark = edges.sparkSession
    head = spark.createDataFrame([(0, "digraph {" if directed else "graph {"), (2, "}")], "_o int, value string")
    return head.unionByName(body).orderBy("_o", "value").select("value")


def adjacency(edges: DataFrame, columns: Sequence[int], missing: float = 0.0) -> DataFrame:
    """A row for each node i with a column for each of the nodes named."""
    return edges.groupBy("i").pivot("j", list(columns)).agg(F.first("v")).na.fill(missing)

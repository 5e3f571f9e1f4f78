"""Blocks, cut nodes, bridges, fundamental cycles and cliques of undirected graphs of any size.

A spanning forest grows by parts that hook onto each other; its Euler tour is a linked list of arcs whose places are found by
pointer doubling. A node's subtree is then a range of places, and what a search in depth would carry along is an aggregate over
ranges, which are cut into blocks of powers of two. Every round is a few joins on equal keys; no node's edges meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import dealt, discard, settled
from .graphs import _tri, components, nodes

#: The neighbours of a node are dealt into so many lists, which are linked: a hub is no single group.
LISTS = 64


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct i < j as longs; loops and nulls are left out."""
    e = edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).where("i <> j")
    return e.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()


def jumped(pointers: DataFrame) -> DataFrame:
    """x, p with p followed to its root, a row that points to itself. pointers: x, p, without other cycles. Kept as a table."""
    now = settled(pointers.select("x", "p", F.lit(True).alias("moved")))
    while not now.where("moved").isEmpty():
        to = now.select(F.col("x").alias("p"), F.col("p").alias("q"))
        now = settled(now.join(dealt(to), "p").select("x", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), now)
    return now


def ranked(following: DataFrame) -> DataFrame:
    """a, end and rank (steps to the end) of linked lists; following: a and b, the next one, null at an end. Kept as a table.

    Each round an element looks up the one it has come to and takes over what that has found; finished ones take no further part.
    """
    start = F.coalesce("b", "a")
    now = settled(following.select("a", start.alias("b"), F.col("b").isNotNull().cast("long").alias("d"), F.col("b").isNull().alias("done")))
    while True:
        open_ = now.where("NOT done")
        if open_.isEmpty():
            return now.select("a", F.col("b").alias("end"), F.col("d").alias("rank"))
        to = now.select(F.col("a").alias("b"), F.col("b").alias("_b"), F.col("d").alias("_d"), F.col("done").alias("_done"))
        step = open_.join(dealt(to), "b").select("a", F.col("_b").alias("b"), (F.col("d") + F.col("_d")).alias("d"), F.col("_done").alias("done"))
        now = settled(now.where("done").unionByName(step), now)


def forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of distinct i < j: the edges i, j of a spanning forest, and node, root of every node.

    In each round every part takes its smallest edge outwards; parts so hooked become one, named by a member of theirs.
    """
    e = settled(edges.select("i", "j", F.col("i").alias("a"), F.col("j").alias("b")))
    part, taken, first = settled(nodes(edges).select("node", F.col("node").alias("root"))), None, True
    while not e.isEmpty():
        out = e.select(F.col("a").alias("x"), F.struct("i", "j").alias("e"), F.col("b").alias("p")).unionByName(e.select(F.col("b").alias("x"), F.struct("i", "j").alias("e"), F.col("a").alias("p")))
        best = settled(out.groupBy("x").agg(F.min(F.struct("e", "p")).alias("m")).select("x", "m.e.i", "m.e.j", "m.p"))
        taken = best.select("i", "j") if taken is None else taken.union(best.select("i", "j"))
        back = best.select(F.col("x").alias("p"), F.col("p").alias("q"))
        hooks = best.join(back, "p").select("x", F.when((F.col("q") == F.col("x")) & (F.col("x") < F.col("p")), F.col("x")).otherwise(F.col("p")).alias("p"))
        roots = jumped(hooks)
        of = lambda c: roots.select(F.col("x").alias(c), F.col("p").alias(f"_{c}"))  # noqa: E731, B023
        e = settled(e.join(of("a"), "a").join(of("b"), "b").where("_a <> _b").groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min(F.struct("i", "j")).alias("e")).select("e.i", "e.j", "a", "b"), e)
        new = roots.select(F.col("x").alias("root"), F.col("p").alias("_r"))
        part = settled(part.join(new, "root", "left").select("node", F.coalesce("_r", "root").alias("root")), part)
        discard(roots)
        first = False
    if first:
        return edges.select("i", "j"), part
    return settled(taken.distinct()), part


def toured(tree: DataFrame, part: DataFrame) -> DataFrame:
    """node, root, parent, low and high of a forest (edges i, j; node, root): the ranges of low to high are nested as subtrees are.

    A root has no parent, low -1 and the largest high; a node without edges is a root. Kept as a table.
    """
    e = settled(tree.select("i", "j", F.monotonically_increasing_id().alias("e")))
    arcs = settled(e.select((F.col("e") * 2).alias("a"), F.col("i").alias("u"), F.col("j").alias("v")).unionByName(e.select((F.col("e") * 2 + 1).alias("a"), F.col("j").alias("u"), F.col("i").alias("v"))))
    out = arcs.select("a", "u", F.pmod(F.xxhash64("a"), F.lit(LISTS)).alias("list"))
    inside, along = Window.partitionBy("u", "list").orderBy("a"), Window.partitionBy("u").orderBy("list")
    heads = out.groupBy("u", "list").agg(F.min("a").alias("head"), F.max("a").alias("a"))
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    links = heads.select("a", F.coalesce(F.lead("head").over(along), F.first("head").over(whole)).alias("over"))
    ring = out.withColumn("next", F.lead("a").over(inside)).join(links, "a", "left").select("a", "u", F.coalesce("next", "over").alias("next"))
    ring = settled(ring)
    # after u -> v comes the arc from v that follows v -> u; the tour is cut before the first arc of each root
    flip = F.when(F.col("a") % 2 == 0, F.col("a") + 1).otherwise(F.col("a") - 1)
    starts = ring.join(part.where("node = root").select(F.col("node").alias("u")), "u", "left_semi").groupBy("u").agg(F.min("a").alias("b"))
    follow = ring.select(flip.alias("a"), F.col("next").alias("b")).join(starts.select("b", F.lit(True).alias("cut")), "b", "left")
    place = ranked(follow.select("a", F.when(F.col("cut").isNull(), F.col("b")).alias("b")))
    both = arcs.join(place, "a").groupBy((F.floor(F.col("a") / 2)).alias("e")).agg(F.max(F.struct("rank", "u", "v")).alias("down"), F.min("rank").alias("low"))
    below = both.select(F.col("down.v").alias("node"), F.col("down.u").alias("parent"), "low", F.col("down.rank").alias("high"))
    found = part.join(below, "node", "left").select("node", "root", "parent", F.coalesce("low", F.lit(-1)).alias("low"), F.coalesce("high", F.lit(2**62)).alias("high"))
    found = settled(found)
    for x in (e, arcs, ring):
        discard(x)
    return found


def _whole(low: Column, high: Column) -> Column:
    """The aligned blocks (k, b), of 2^k places from b 2^k on, that make up low to high: two of a size at most."""
    size = lambda k: F.pow(F.lit(2.0), k)
    top = F.floor(F.log2((high - low + 1).cast("double"))).cast("int")

    def at(k: Column) -> Column:
        left, right = F.ceil(low / size(k)), F.floor((high + 1) / size(k))
        pick = lambda odd, b: F.when((left < right) & (odd % 2 == 1), F.struct(k.alias("k"), b.cast("long").alias("b")))
        return F.filter(F.array(pick(left, left), pick(right, right - 1)), lambda x: x.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), top), at))


def over_ranges(ranges: DataFrame, points: DataFrame, by: str, aggregates: dict[str, Column]) -> DataFrame:
    """id and aggregates (such as minima, which may be taken of their own results) of all points (by, place, values) in each of ranges (id, by, low, high);
    those without points are left out. The aggregates' names are the points' columns."""
    highest = points.agg(F.max("place")).first()[0]
    if highest is None:
        return ranges.select("id", *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in aggregates]).limit(0)
    levels = F.explode(F.sequence(F.lit(0), F.lit(int(highest).bit_length()))).alias("k")
    held = points.select(by, "place", *aggregates, levels)
    held = held.groupBy(by, "k", F.floor(F.col("place") / F.pow(F.lit(2.0), F.col("k"))).cast("long").alias("b")).agg(*[v.alias(k) for k, v in aggregates.items()])
    asked = ranges.select("id", by, F.explode(_whole(F.col("low"), F.col("high"))).alias("x")).select("id", by, "x.k", "x.b")
    return asked.join(held, [by, "k", "b"]).groupBy("id").agg(*[v.alias(k) for k, v in aggregates.items()])


def blocks(edges: DataFrame) -> DataFrame:
    """Every edge i < j of an undirected graph with the block (maximal part that no single node's removal parts) it is in, named by its smallest edge: i, j, block_i, block_j.

    A tree edge is named by its lower node. Two are in one block if an edge joins nodes below them of which neither is above the other, or if the upper one's
    subtree is left by an edge from below the lower one; blocks are the components of these links. Another edge is in the block of its lower end.
    """
    e = settled(undirected(edges))
    tree, part = forest(e)
    tour = toured(tree, part)
    end = lambda c: tour.select(F.col("node").alias(c), "root", *[F.col(x).alias(f"{c}_{x}") for x in ("low", "high")])
    rest = settled(e.join(tree, ["i", "j"], "left_anti").join(end("i"), "i").join(end("j").drop("root"), "j"))
    to = lambda a, b: rest.select("root", F.col(f"{a}_low").alias("place"), F.col(f"{b}_low").alias("first"), F.col(f"{b}_low").alias("last"))
    points = to("i", "j").unionByName(to("j", "i")).where("place >= 0")  # a root's subtree is never asked for
    above = tour.select(F.col("node").alias("parent"), F.col("low").alias("p_low"), F.col("high").alias("p_high"))
    lower = settled(tour.where("parent IS NOT NULL").join(above.where("p_low >= 0"), "parent").select(F.col("node").alias("id"), "root", "low", "high", "parent", "p_low", "p_high"))
    marks = over_ranges(lower, points, "root", {"first": F.min("first"), "last": F.max("last")})
    leaves = lower.join(marks, "id").where("first < p_low OR last > p_high").select(F.col("id").alias("i"), F.col("parent").alias("j"))
    apart = (F.col("i_low") > F.col("j_high")) | (F.col("j_low") > F.col("i_high"))
    across = rest.where(apart).select("i", "j")
    same = components(leaves.union(across), tour.where("parent IS NOT NULL").select("node"))
    named = settled(same.select(F.col("node").alias("lower"), "component"))
    below_of = tour.where("parent IS NOT NULL").select(F.col("node").alias("lower"), F.least("node", "parent").alias("i"), F.greatest("node", "parent").alias("j"))
    lower_end = F.when(~apart & (F.col("i_low") < F.col("j_low")), F.col("j")).otherwise(F.col("i"))  # where neither is above, either will do
    ends = below_of.unionByName(rest.select(lower_end.alias("lower"), "i", "j"))
    found = settled(ends.join(named, "lower").select("i", "j", "component"))
    names = found.groupBy("component").agg(F.min(F.struct("i", "j")).alias("b"))
    return found.join(names, "component").select("i", "j", F.col("b.i").alias("block_i"), F.col("b.j").alias("block_j"))


def cut_nodes(found: DataFrame) -> DataFrame:
    """node and blocks of the nodes in two blocks or more; found: as blocks() gives it."""
    of = found.select(F.explode(F.array("i", "j")).alias("node"), "block_i", "block_j").distinct()
    return of.groupBy("node").agg(F.count("*").alias("blocks")).where("blocks > 1")


def bridges(found: DataFrame) -> DataFrame:
    """The edges i, j that are a block of their own."""
    return found.groupBy("block_i", "block_j").agg(F.count("*").alias("n")).where("n = 1").select(F.col("block_i").alias("i"), F.col("block_j").alias("j"))


def cycles(edges: DataFrame) -> DataFrame:
    """A fundamental set of cycles: each edge outside a spanning forest with the path between its ends inside: i, j (that edge), place (from 0, at i, to the
    length less 1, at j) and node. The nodes listed are as many as all cycles have together.

    The lowest node above both ends is the least deep one's parent between their places on the tour. Paths are cut in halves: whose
    upper part begins at an ancestor 2^k steps up, found by doubling, so that a path of any length takes rounds in its logarithm.
    """
    e = settled(undirected(edges))
    tree, part = forest(e)
    tour = toured(tree, part)
    depth = ranked(tour.select(F.col("node").alias("a"), F.col("parent").alias("b"))).select(F.col("a").alias("node"), F.col("rank").alias("depth"))
    placed = settled(tour.join(depth, "node"))
    end = lambda c: placed.select(F.col("node").alias(c), "root", *[F.col(x).alias(f"{c}_{x}") for x in ("low", "high", "depth")])
    rest = settled(e.join(tree, ["i", "j"], "left_anti").join(end("i"), "i").join(end("j").drop("root"), "j").withColumn("id", F.monotonically_increasing_id()))
    between = rest.where("i_low > j_high OR j_low > i_high").select("id", "root", F.least("i_low", "j_low").alias("low"), F.greatest("i_low", "j_low").alias("high"))
    points = placed.where("parent IS NOT NULL").select("root", F.col("low").alias("place"), F.struct(F.col("depth"), F.col("parent")).alias("m"))
    meet = over_ranges(between, points, "root", {"m": F.min("m")}).select("id", (F.col("m.depth") - 1).alias("meet"))
    sides = rest.join(meet, "id", "left").withColumn("meet", F.coalesce("meet", F.least("i_depth", "j_depth")))
    sides = sides.withColumns({"a": F.col("i_depth") - F.col("meet"), "b": F.col("j_depth") - F.col("meet")})
    # v, how many of its ancestors from itself on, the first one's place and the way that places go
    rows = sides.select("i", "j", F.col("i").alias("v"), (F.col("a") + 1).alias("n"), F.lit(0).cast("long").alias("place"), F.lit(1).alias("way"))
    rows = settled(rows.unionByName(sides.where("b > 0").select("i", "j", F.col("j").alias("v"), F.col("b").alias("n"), (F.col("a") + F.col("b")).alias("place"), F.lit(-1).alias("way"))))
    longest = rows.agg(F.max("n")).first()[0] or 0
    ups = [settled(tour.where("parent IS NOT NULL").select(F.col("node").alias("v"), F.col("parent").alias("up")))]
    while 2 ** len(ups) < longest:
        ups.append(settled(ups[-1].join(ups[-1].select(F.col("v").alias("up"), F.col("up").alias("_u")), "up").select("v", F.col("_u").alias("up"))))
    for k in range(len(ups) - 1, -1, -1):
        step, more = 2**k, F.col("n") > 2**k
        upper = rows.where(more).join(ups[k], "v").select("i", "j", F.col("up").alias("v"), (F.col("n") - step).alias("n"), (F.col("place") + step * F.col("way")).alias("place"), "way")
        rows = settled(rows.withColumn("n", F.least("n", F.lit(step).cast("long"))).unionByName(upper), rows)
    return rows.select("i", "j", "place", F.col("v").alias("node"))


def _grown(near: dict[int, set[int]]) -> list[list[int]]:
    """All maximal cliques of a small graph given as neighbours of each node; a pivot leaves out what its neighbours lead to."""
    out, todo = [], [([], set(near), set())]
    while todo:
        held, may, done = todo.pop()
        if not may and not done:
            out.append(held)
            continue
        pivot = max(may | done, key=lambda v: len(near[v] & may))
        for v in list(may - near[pivot]):
            todo.append(([*held, v], may & near[v], done & near[v]))
            may.remove(v)
            done.add(v)
    return out


def cliques(edges: DataFrame, least: int = 2) -> DataFrame:
    """clique (sorted array of nodes) and size of all maximal cliques of least nodes or more.

    Edges point to their end of the higher degree (ties to the larger node), so that a node has at most the root of twice the edges after
    it. A clique is found at its first node, in the graph of the nodes after it, which one task holds; it is maximal unless a node before that one is
    linked to all of it. Their number may be exponential in the most nodes after one.
    """
    e = settled(undirected(edges))
    deg = e.select(F.explode(F.array("i", "j")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    of = lambda c: deg.select(F.col("node").alias(c), F.col("d").alias(f"d{c}"))
    first = F.struct("di", "i") < F.struct("dj", "j")
    arcs = settled(e.join(of("i"), "i").join(of("j"), "j").select(F.when(first, F.col("i")).otherwise(F.col("j")).alias("a"), F.when(first, F.col("j")).otherwise(F.col("i")).alias("b")))
    inner = _tri(e.select("i", "j")).select("a", "b", "c")
    rows = arcs.select("a", "b", F.lit(None).cast("long").alias("c")).unionByName(inner)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A node's rows stand together; those of a batch's last node may go on in the next batch."""
        at, near = None, {}
        for batch in batches:
            out = []
            for a, b, c in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if a != at:
                    out += [(at, sorted(x)) for x in _grown(near)] if near else []
                    at, near = a, {}
                near.setdefault(b, set())
                if c is not None:
                    near[b].add(c)
                    near.setdefault(c, set()).add(b)
            yield told(out)
        if near:
            yield told([(at, sorted(x)) for x in _grown(near)])

    def told(out: list[tuple[int, list[int]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([x for _, x in out], pa.list_(pa.int64()))], names=["a", "rest"])

    together = rows.repartition("a").sortWithinPartitions("a")
    got = settled(together.mapInArrow(found, "a long, rest array<long>").withColumn("id", F.monotonically_increasing_id()))
    before = got.select("id", "a", "rest").join(arcs.select(F.col("b").alias("a"), F.col("a").alias("x")), "a")
    links = before.select("id", "x", F.size("rest").alias("n"), F.explode("rest").alias("w"))
    links = links.join(e.select("i", "j"), (F.least("x", "w") == F.col("i")) & (F.greatest("x", "w") == F.col("j")))
    wider = links.groupBy("id", "x").agg(F.first("n").alias("n"), F.count("*").alias("seen")).where("seen = n").select("id").distinct()
    out = got.join(wider, "id", "left_anti").select(F.array_sort(F.concat(F.array("a"), "rest")).alias("clique"))
    return out.withColumn("size", F.size("clique")).where(F.col("size") >= least)

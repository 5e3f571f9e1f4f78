"""Locally weighted lines through series of any length.

A fit at x needs sums over the nearest rows with weights (1 - |d / h|^3)^3, a polynomial in the distance on either side. So rows
are reduced to moments of aligned blocks of the order, which give their sums by a shift of their moments to x. Values are fitted a
chunk at a time: its windows begin and end in a few chunks, whose values are weighed one by one, and what is whole between them is
one range of blocks for all of the chunk. Blocks, widths h and medians of the residuals are joins and grouped sums; no task sees a
whole series.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import dealt, discard, settled
from ..plans.ordered import matches, positions, running
from .blocks import _whole

#: 2 to the power CHUNK values are fitted together; 2 to the power BITS chunks are added up to blocks in one task, and again that many of those in the next round.
CHUNK, BITS = 9, 10
#: Moments of the weights and of the weighted values that a fit reads.
_W, _V = 12, 11
_PASCAL = np.array([[comb(p, j) for j in range(_W)] for p in range(_W)], float)
#: Kinds of what a chunk is sent: its own windows, values of a chunk; from 0, blocks of 2^k chunks.
_WINDOWS, _VALUES = -2, -1


def _shifted(m: np.ndarray, e: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Moments of e + s z from moments m (rows by powers) of z."""
    n = m.shape[1]
    up = e[:, None] ** np.arange(n)
    m = m * s[:, None] ** np.arange(n)
    return np.column_stack([(up[:, p::-1] * m[:, : p + 1]) @ _PASCAL[p, : p + 1] for p in range(n)])


def _halved(f: pd.DataFrame, level: int, bits: int) -> pd.DataFrame:
    """Blocks of one level (b, c, r, w, v: place, centre, radius, moments) and all those of the next bits levels above."""
    b, c, r = f["b"].to_numpy(), f["c"].to_numpy(), f["r"].to_numpy()
    w, v = np.stack(f["w"].to_list()), np.stack(f["v"].to_list())
    order = np.argsort(b)
    b, c, r, w, v = b[order], c[order], r[order], w[order], v[order]
    out = []
    for k in range(1, bits + 1):
        up, at = np.unique(b >> 1, return_index=True)
        low, high = np.minimum.reduceat(c - r, at), np.maximum.reduceat(c + r, at)
        nc, nr = (low + high) / 2, (high - low) / 2
        of = np.searchsorted(up, b >> 1)
        scale = np.where(nr > 0, nr, 1.0)[of]
        e, s = (c - nc[of]) / scale, r / scale
        w, v = np.add.reduceat(_shifted(w, e, s), at), np.add.reduceat(_shifted(v, e, s), at)
        b, c, r = up, nc, nr
        out.append(pd.DataFrame({"k": level + k, "b": b, "c": c, "r": r, "w": list(w), "v": list(v)}))
    return pd.concat(out)


def _chunk(place: Column) -> Column:
    return F.shiftright(place, CHUNK)


def _parts(df: DataFrame, chunks: int) -> int:
    """Partitions for so many chunks: their work is more than their bytes tell."""
    return max(1, min(chunks, max(2 * df.sparkSession.sparkContext.defaultParallelism, chunks // 64)))


def _chunks(values: DataFrame, chunks: int) -> DataFrame:
    """_s, b, data of all chunks of values (_s, q: place from 0, x, t and ty: sums of weights and of weighted values): x, t and ty in the order of places, one after the other."""
    packed = values.repartition(_parts(values, chunks), "_s", _chunk(F.col("q"))).groupBy("_s", _chunk(F.col("q")).alias("b")).agg(F.array_sort(F.collect_list(F.struct("q", "x", "t", "ty"))).alias("z"))
    return packed.select("_s", "b", F.concat("z.x", "z.t", "z.ty").alias("data"))


def _blocks(held: DataFrame, most: int) -> DataFrame:
    """_s, k, b, c, r, w, v of all aligned blocks of 2^k chunks; held: chunks (_s, b, data), at most so many in a series."""
    kind = "_s long, k int, b long, c double, r double, w array<double>, v array<double>"

    def leaf(frames):
        for f in frames:
            out = []
            for d in f["data"]:
                x, t, ty = d.reshape(3, -1)
                c, r = (x[0] + x[-1]) / 2, (x[-1] - x[0]) / 2
                z = ((x - c) / (r or 1.0))[:, None] ** np.arange(_W)
                out.append((c, r, t @ z, ty @ z[:, :_V]))
            yield pd.DataFrame({"_s": f["_s"], "k": 0, "b": f["b"]} | {n: [o[i] for o in out] for i, n in enumerate("crwv")})

    def above(level: int):
        def run(f: pd.DataFrame) -> pd.DataFrame:
            out = _halved(f, level, BITS)
            out.insert(0, "_s", f["_s"].iloc[0])
            return out

        return run

    found = last = settled(held.mapInPandas(leaf, kind))
    level = 0
    while 1 << level < most:
        new = settled(last.groupBy("_s", F.shiftright("b", BITS)).applyInPandas(above(level), kind))
        found, last, level = found.unionByName(new), new.where(F.col("k") == level + BITS), level + BITS
    return found


def _windows(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """_s, q, h, left, right: how wide the nearest rows of each value reach and the places of the first and last value among them.

    Of all runs of n rows (_s, n) the last whose middle isn't above x and the next one are the candidates: x lies in one of the two nearest. Their number is
    a running count over values and middles together.
    """
    step = F.lit(65536).cast("long")  # rows of one value are told in runs, so that no list of them is long
    first = F.explode(F.sequence(F.col("after") - F.col("rows"), F.col("after") - 1, step)).alias("at")
    runs = values.select("_s", "x", "q", "after", first).select("_s", "x", "q", F.explode(F.sequence("at", F.least(F.col("at") + step - 1, F.col("after") - 1))).alias("p"))
    place = settled(runs)
    other = place.join(sizes, "_s").select("_s", (F.col("p") - F.col("n") + 1).alias("p"), F.col("x").alias("_x"))
    middles = place.join(other, ["_s", "p"]).select("_s", ((F.col("x") + F.col("_x")) / 2).alias("x"), F.lit(1).alias("m"))
    marks = middles.unionByName(values.select("_s", "x", F.lit(0).alias("m"))).groupBy("_s", "x").agg(F.sum("m").alias("m"))
    counted = running(settled(marks), "x", {"l": F.col("m")}, by=["_s"]).select("_s", "x", (F.col("l") - 1).alias("l"))
    asked = settled(values.join(counted, ["_s", "x"]).join(sizes, "_s").select("_s", "q", "x", "l", "n"))
    # before: the run that begins at l; after: the one that begins at l + 1
    ends = F.explode(F.array(*[F.struct(F.lit(w).alias("which"), p.alias("p")) for w, p in (("a", F.col("l")), ("b", F.col("l") + F.col("n") - 1), ("c", F.col("l") + 1), ("d", F.col("l") + F.col("n")))])).alias("e")
    seen = asked.select("_s", "q", ends).select("_s", "q", "e.which", "e.p").join(place.select("_s", "p", F.col("x").alias("at"), F.col("q").alias("to")), ["_s", "p"])
    pick = lambda which, c: F.max(F.when(F.col("which") == which, F.col(c)))
    got = seen.groupBy("_s", "q").agg(*[pick(w, c).alias(f"{w}_{c}") for w in "abcd" for c in ("at", "to")])
    back, ahead = F.when(F.col("b_at").isNotNull(), F.col("x") - F.col("a_at")), F.when(F.col("c_at").isNotNull(), F.col("d_at") - F.col("x"))
    ahead_is = back.isNull() | (ahead < back)
    out = asked.join(got, ["_s", "q"])
    return out.select("_s", "q", "x", F.least(back, ahead).alias("h"), F.when(ahead_is, F.col("c_to")).otherwise(F.col("a_to")).alias("left"), F.when(ahead_is, F.col("d_to")).otherwise(F.col("b_to")).alias("right"))


def _needs(windows: DataFrame) -> DataFrame:
    """_s, at, k, b: what each chunk (at) is sent: the values of the chunks in which its windows begin or end and its own, and blocks for the ranges of chunks between."""
    at = _chunk(F.col("q"))
    ends = windows.where("h > 0").select("_s", at.alias("at"), _chunk(F.col("left")).alias("low"), _chunk(F.col("right")).alias("high")).distinct()
    ends = settled(ends)
    values = ends.select("_s", "at", F.lit(_VALUES).alias("k"), F.explode(F.array("low", "at", "high")).alias("b"))
    between = lambda low, high: F.struct(low.alias("low"), high.alias("high"))
    ranges = ends.select("_s", "at", F.explode(F.array(between(F.col("low") + 1, F.col("at") - 1), between(F.col("at") + 1, F.col("high") - 1))).alias("r")).where("r.low <= r.high").distinct()
    blocks = ranges.select("_s", "at", F.explode(_whole(F.col("r.low"), F.col("r.high"))).alias("z")).select("_s", "at", F.col("z.k").cast("int").alias("k"), "z.b")
    return values.unionByName(blocks).distinct()


def _aligned(low: int, high: int) -> list[tuple[int, int]]:
    """The blocks that _whole gives of low to high."""
    out, k, high = [], 0, high + 1
    while low < high:
        if low & 1:
            out.append((k, low))
            low += 1
        if high & 1:
            high -= 1
            out.append((k, high))
        low, high, k = low >> 1, high >> 1, k + 1
    return out


def _sums(f: pd.DataFrame) -> pd.DataFrame:
    """_s, q and the sums w0 to v1 of one chunk; f: at, and what it was sent (k, b, data)."""
    at = int(f["at"].iloc[0])
    sent = {(k, b): d for k, b, d in zip(f["k"], f["b"], f["data"])}
    q, x, h, left, right = sent.pop((_WINDOWS, at)).reshape(5, -1)
    low, high = left.astype("int64") >> CHUNK, right.astype("int64") >> CHUNK
    total = np.zeros((len(q), 5))
    for (k, b), data in sent.items():
        of = np.flatnonzero((low == b) | (high == b) | (b == at)) if k == _VALUES else []
        if not len(of):
            continue
        xs, t, ty = data.reshape(3, -1)
        place = (b << CHUNK) + np.arange(len(xs))
        d = (xs - x[of, None]) / h[of, None]
        size = np.abs(d)
        weight = np.maximum(1 - size * size * size, 0.0)
        weight = np.where((place >= left[of, None]) & (place <= right[of, None]), weight * weight * weight, 0.0)
        first = weight * d
        total[of] += np.column_stack([weight @ t, first @ t, (first * d) @ t, weight @ ty, first @ ty])
    for way, begin, end in ((-1.0, low + 1, np.full(len(q), at - 1)), (1.0, np.full(len(q), at + 1), high - 1)):
        for a, z in {(a, z) for a, z in zip(begin.tolist(), end.tolist()) if a <= z}:
            of = np.flatnonzero((begin == a) & (end == z))
            m = np.stack([sent[key] for key in _aligned(a, z)])
            c, r = m[:, 0], m[:, 1]
            least, most = (c - r).min(), (c + r).max()
            middle, radius = (least + most) / 2, (most - least) / 2
            e, s = (c - middle) / (radius or 1.0), r / (radius or 1.0)
            e, s, w, v = (middle - x[of]) / h[of], radius / h[of], _shifted(m[:, 2 : 2 + _W], e, s).sum(0), _shifted(m[:, 2 + _W :], e, s).sum(0)
            w, v = _shifted(np.tile(w, (len(of), 1)), e, s), _shifted(np.tile(v, (len(of), 1)), e, s)
            sums = lambda m, p: m[:, p] - 3 * way * m[:, p + 3] + 3 * m[:, p + 6] - way * m[:, p + 9]  # noqa: B023, E731
            total[of] += np.column_stack([sums(w, 0), sums(w, 1), sums(w, 2), sums(v, 0), sums(v, 1)])
    return pd.DataFrame({"_s": f["_s"].iloc[0], "q": q.astype("int64")} | {c: total[:, i] for i, c in enumerate(("w0", "w1", "w2", "v0", "v1"))})


def _fitted(values: DataFrame, windows: DataFrame, needs: DataFrame, most: int, chunks: int) -> DataFrame:
    """_s, q and fit (null where no row has weight). most: values of a series at most; chunks: of all series."""
    at = _chunk(F.col("q"))
    held = settled(_chunks(values, chunks))
    blocks = _blocks(held, (most >> CHUNK) + 1).select("_s", "k", "b", F.concat(F.array("c", "r"), "w", "v").alias("data"))
    kept = blocks.unionByName(held.select("_s", F.lit(_VALUES).alias("k"), "b", "data"))
    own = windows.where("h > 0").groupBy("_s", at.alias("at")).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in ("q", "x", "h", "left", "right")])).alias("z"))
    own = own.select("_s", "at", F.lit(_WINDOWS).alias("k"), F.col("at").alias("b"), F.concat("z.q", "z.x", "z.h", "z.left", "z.right").alias("data"))
    sent = needs.join(dealt(kept), ["_s", "k", "b"]).select("_s", "at", "k", "b", "data").unionByName(own)
    sums = sent.repartition(_parts(values, chunks), "_s", "at").groupBy("_s", "at").applyInPandas(_sums, "_s long, q long, w0 double, w1 double, w2 double, v0 double, v1 double")
    total = settled(sums)
    out = windows.select("_s", "q", "h").join(dealt(total), ["_s", "q"], "left").join(dealt(values.select("_s", "q", "t", "ty")), ["_s", "q"])
    middle, level = F.col("w1") / F.col("w0"), F.col("v0") / F.col("w0")
    spread, tilt = F.col("w2") - F.col("w1") * middle, F.col("v1") - middle * F.col("v0")
    line = level - F.when(spread * F.col("h") * F.col("h") > 1e-12, tilt / spread * middle).otherwise(0.0)
    return out.select("_s", "q", F.when(F.col("h") > 0, F.when(F.col("w0") > 0, line)).otherwise(F.when(F.col("t") > 0, F.col("ty") / F.col("t"))).alias("fit"))


def _medians(rough: DataFrame) -> DataFrame:
    """_s and median of r."""
    values = rough.groupBy("_s", "r").agg(F.count("*").alias("n"))
    seen = running(settled(values), "r", {"upto": F.col("n")}, by=["_s"])
    size = rough.groupBy("_s").agg(F.count("*").alias("all"))
    at = seen.join(size, "_s").where("upto * 2 >= all AND (upto - n) * 2 <= all")  # the values about the middle
    return at.groupBy("_s").agg(F.when(F.count("*") > 1, (F.min("r") + F.max("r")) / 2).otherwise(F.max("r")).alias("median"))


def lowess(df: DataFrame, x: str, y: str, by: Sequence[str] = (), share: float = 0.5, robust: int = 3) -> DataFrame:
    """Locally weighted lines with tricube weights over the nearest share of each series, reweighted by bisquare: by, x, y, smooth.

    Series of any length, named by by (nulls are a name too) or all rows as one. Rows with a null in x or y are left out. A series whose median
    residual is 0 keeps its fit. Where no neighbour has weight left, a fit keeps its value of the round before.
    """
    by = list(by)
    rows = df.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"])
    if by:
        names = settled(rows.select(*by).distinct().withColumn("_s", F.monotonically_increasing_id()))
        rows = matches(rows, names, by)
    else:
        rows = rows.withColumn("_s", F.lit(0).cast("long"))
    rows = settled(rows)
    sizes = settled(rows.groupBy("_s").agg(F.count("*").alias("rows")).select("_s", F.greatest(F.lit(2), F.least("rows", F.ceil(F.col("rows") * share))).alias("n"), "rows"))
    sizes = sizes.select("_s", F.least("n", "rows").alias("n"))
    values = rows.groupBy("_s", "x").agg(F.count("*").alias("rows"))
    values = settled(positions(running(settled(values), "x", {"after": F.col("rows")}, by=["_s"]), "x", "q", by=["_s"]).withColumn("q", F.col("q") - 1))
    size = values.agg(F.max("q").alias("last"), F.count_if(F.col("q") % (1 << CHUNK) == 0).alias("chunks")).first()
    most, chunks = (size.last or 0) + 1, max(size.chunks, 1)
    windows = settled(_windows(values, sizes))
    needs = settled(_needs(windows))
    places = values.select("_s", "x", "q")
    rows = settled(rows.join(places, ["_s", "x"]).select(*by, "_s", "x", "y", "q", F.lit(1.0).alias("trust"), F.col("y").alias("smooth")), rows)
    for k in range(robust + 1):
        weighed = rows.groupBy("_s", "q").agg(F.first("x").alias("x"), F.sum("trust").alias("t"), F.sum(F.col("trust") * F.col("y")).alias("ty"))
        fit = _fitted(settled(weighed), windows, needs, most, chunks)
        out = rows.join(fit, ["_s", "q"]).withColumn("smooth", F.coalesce("fit", "smooth")).drop("fit")
        rows = settled(out, rows)
        if k < robust:
            wide = _medians(rows.select("_s", F.abs(F.col("y") - F.col("smooth")).alias("r"))).select("_s", (6 * F.col("median")).alias("m"))
            u = F.abs(F.col("y") - F.col("smooth")) / F.col("m")
            again = F.pow(F.greatest(1 - u * u, F.lit(0.0)), 2.0)
            rows = settled(rows.join(wide, "_s").withColumn("trust", F.when(F.col("m") > 0, again).otherwise(F.col("trust"))).drop("m"), rows)
    discard(windows)
    return rows.select(*by, F.col("x").alias(x), F.col("y").alias(y), "smooth")

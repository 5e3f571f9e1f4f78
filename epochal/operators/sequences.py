"""State sequences: one row for each case with an array of states by discrete time; negative states and nulls are missing.

Long form has id, t (from 0) and state.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import filled, span
from ..plans.ordered import positions


def from_columns(df: DataFrame, id: str, columns: Sequence[str], recode: dict[int, int] | None = None, fill: int = 0) -> DataFrame:
    """id and states from a column for each time; recode maps states, gaps of up to fill between equal states are filled."""
    from ..functions.scalar import recoded

    one = lambda c: (recoded(F.col(c).cast("double"), recode) if recode else F.col(c)).cast("int")
    out = df.select(F.col(id).alias("id"), F.array(*[one(c) for c in columns]).alias("states"))
    return out.withColumn("states", filled("states", fill)) if fill else out


def from_pairs(df: DataFrame, id: str, pairs: Sequence[tuple[str, str]], first: int, last: int) -> DataFrame:
    """id and states at the times first to last from (state, start time) column pairs: a state holds from its start to the next; the last
    one's time ends the sequence, and its state holds at it too."""
    known = F.array(*[F.struct(F.col(t).cast("double").alias("t"), F.col(s).cast("int").alias("s")) for s, t in pairs])
    known = F.filter(known, lambda p: (p["t"] >= 0) & p["s"].isNotNull())
    end = F.array_max(F.transform(known, lambda p: p["t"]))

    def at(t: Column) -> Column:
        held = F.array_max(F.filter(known, lambda p: p["t"] <= t))["s"]
        return F.when(t <= end, F.coalesce(held, F.lit(-1))).otherwise(-1)

    return df.select(F.col(id).alias("id"), F.transform(F.sequence(F.lit(first), F.lit(last)), at).alias("states"))


def from_long(rows: DataFrame, id: str, order: str | Sequence[str], state: str) -> DataFrame:
    """id and states from a row for each place, in the order of the columns named; a sequence must fit in a task."""
    keys = [order] if isinstance(order, str) else list(order)
    got = rows.groupBy(F.col(id).alias("id")).agg(F.array_sort(F.collect_list(F.struct(*keys, F.coalesce(F.col(state).cast("int"), F.lit(-1)).alias("_s")))).alias("_a"))
    return got.select("id", F.transform("_a", lambda x: x["_s"]).alias("states"))


def from_episodes(episodes: DataFrame, times: Sequence[int]) -> DataFrame:
    """id and states: the origin of the spell that holds at each time (the first, if several do), -1 without one."""
    inside = F.filter(F.array(*[F.lit(int(t)) for t in times]), lambda t: (t >= F.col("ts")) & (t < F.col("tf")))
    rows = episodes.select("id", "ts", "sn", "org", F.explode(inside).alias("t"))
    held = rows.groupBy("id", "t").agg(F.min(F.struct("ts", "sn", "org"))["org"].alias("s")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("t", "s"))).alias("_m"))
    all_ = episodes.select("id").distinct().join(held, "id", "left")
    return all_.select("id", F.array(*[F.coalesce(F.try_element_at("_m", F.lit(int(t))), F.lit(-1)) for t in times]).alias("states"))


def to_long(seq: DataFrame) -> DataFrame:
    return seq.select("id", F.posexplode("states").alias("t", "state"))


def lengths(seq: DataFrame) -> DataFrame:
    """id, first and last place that isn't missing (null without any), length between them, and gaps: their number, total, shortest and longest."""
    ok = F.transform("states", lambda x: F.coalesce(x >= 0, F.lit(False)))
    first = F.array_position(ok, True) - 1
    length = span("states")
    inner = F.slice(ok, (first + 1).cast("int"), length.cast("int"))
    text = F.concat_ws("", F.transform(inner, lambda b: F.when(b, "1").otherwise("0")))
    runs = F.when(length > 0, F.transform(F.regexp_extract_all(text, F.lit("0+"), F.lit(0)), lambda r: F.length(r)))
    out = seq.select("id", F.when(length > 0, first).alias("first"), F.when(length > 0, first + length - 1).alias("last"), length.alias("length"), F.coalesce(runs, F.array().cast("array<int>")).alias("_r"))
    return out.select("id", "first", "last", "length", F.size("_r").cast("long").alias("gaps"), F.aggregate("_r", F.lit(0), lambda s, x: s + x).cast("long").alias("gap_total"), F.array_min("_r").alias("gap_min"), F.array_max("_r").alias("gap_max"))


def last_place(seq: DataFrame, state: int) -> DataFrame:
    """id and the place where state is last, -1 if nowhere."""
    back = F.array_position(F.reverse("states"), state)
    return seq.select("id", F.when(back > 0, F.size("states") - back).otherwise(-1).cast("long").alias("last_place"))


def spells(seq: DataFrame) -> DataFrame:
    """id, spell (from 1), state, start, length of every run of equal states; missing ones are runs of -1."""
    a = F.transform("states", lambda x: F.coalesce(F.greatest(x, F.lit(-1)), F.lit(-1)))
    n = F.size("_a")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("_a", i) != F.get("_a", i - 1)))
    rows = seq.select("id", a.alias("_a")).where(n > 0).withColumn("_s", starts)
    out = rows.select("id", "_a", n.alias("_n"), "_s", F.posexplode("_s").alias("_k", "start"))
    end = F.coalesce(F.get("_s", F.col("_k") + 1), F.col("_n"))
    return out.select("id", (F.col("_k") + 1).alias("spell"), F.get("_a", F.col("start")).alias("state"), "start", (end - F.col("start")).alias("length"))


def characteristics(seq: DataFrame) -> DataFrame:
    """id, distinct states, changes between known states, missing places, and maps of duration and number of spells by state."""
    s = spells(seq)
    known = s.where("state >= 0")
    per = known.groupBy("id", "state").agg(F.sum("length").alias("d"), F.count("*").alias("n"))
    maps = per.groupBy("id").agg(F.count("*").alias("distinct_states"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "d")))).alias("durations"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("spell_counts"))
    base = s.groupBy("id").agg(F.coalesce(F.sum(F.when(F.col("state") < 0, F.col("length"))), F.lit(0)).alias("missing"))
    pairs = changes(seq).groupBy("id").agg(F.count("*").alias("changes"))
    return base.join(maps, "id", "left").join(pairs, "id", "left").select("id", F.coalesce("distinct_states", F.lit(0)).alias("distinct_states"), F.coalesce("changes", F.lit(0)).alias("changes"), "missing", "durations", "spell_counts")


def distribution(seq: DataFrame) -> DataFrame:
    """t, state (-1: missing), n and share among the known."""
    cells = to_long(seq).select("t", F.coalesce(F.greatest("state", F.lit(-1)), F.lit(-1)).alias("state")).groupBy("t", "state").agg(F.count("*").alias("n"))
    known = cells.where("state >= 0").groupBy("t").agg(F.sum("n").alias("_n"))
    return cells.join(known, "t", "left").select("t", "state", "n", F.when(F.col("state") >= 0, F.col("n") / F.col("_n")).alias("share"))


def entropy(seq: DataFrame) -> DataFrame:
    """t, n (known), entropy of the state distribution."""
    return distribution(seq).where("state >= 0").groupBy("t").agg(F.sum("n").alias("n"), F.sum(-F.col("share") * F.log("share")).alias("entropy"))


def changes(seq: DataFrame) -> DataFrame:
    """id, t (of the destination), org, des of every change from one known state to another at the next place."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("states") - 1), lambda i: F.struct(i.alias("t"), F.get("states", i - 1).alias("org"), F.get("states", i).alias("des")))
    rows = seq.where(F.size("states") > 1).select("id", F.explode(F.filter(pairs, lambda p: (p["org"] >= 0) & (p["des"] >= 0) & (p["org"] != p["des"]))).alias("_p"))
    return rows.select("id", "_p.t", "_p.org", "_p.des")


def change_counts(seq: DataFrame) -> DataFrame:
    return changes(seq).groupBy("org", "des").agg(F.count("*").alias("n"))


def transition_shares(seq: DataFrame, by_time: bool = True) -> DataFrame:
    """t, org, des (-1: missing), n, share of those in org, and movers: the share that leaves org among those known next."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("states") - 1), lambda i: F.struct((i - 1).alias("t"), F.get("states", i - 1).alias("org"), F.coalesce(F.greatest(F.get("states", i), F.lit(-1)), F.lit(-1)).alias("des")))
    rows = seq.where(F.size("states") > 1).select(F.explode(F.filter(pairs, lambda p: p["org"] >= 0)).alias("_p")).select("_p.*")
    keys = ["t", "org"] if by_time else ["org"]
    cells = rows.groupBy(*keys, "des").agg(F.count("*").alias("n"))
    tops = cells.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum(F.when(F.col("des") >= 0, F.col("n"))).alias("_k"), F.sum(F.when((F.col("des") >= 0) & (F.col("des") != F.col("org")), F.col("n")).otherwise(0)).alias("_m"))
    return cells.join(tops, keys).select(*keys, "des", "n", (F.col("n") / F.col("_n")).alias("share"), (F.col("_m") / F.col("_k")).alias("movers"))


def indicators(seq: DataFrame, states: Sequence[int]) -> DataFrame:
    """id and a 0/1 array over time for each state: s<state>."""
    flags = lambda s: F.transform("states", lambda x: F.when(x == s, 1).otherwise(0)).alias(f"s{s}")
    return seq.select("id", *[flags(s) for s in states])


def members(seq: DataFrame, conditions: Sequence[tuple[int, int, int]]) -> DataFrame:
    """id and group: the number (from 1) of the first condition (state, at least, at most places in it) that holds, 0 if none."""
    group, places = F.lit(0), lambda s: F.size(F.filter("states", lambda x: x == s))
    for k, (s, low, high) in reversed(list(enumerate(conditions, 1))):
        group = F.when(places(s).between(low, high), k).otherwise(group)
    return seq.select("id", group.alias("group"))


def matching(seq: DataFrame, pattern: Sequence[int | str]) -> DataFrame:
    """id and n: places without overlap where the pattern stands: states, "?" (one state), "+" (one or more), "*" (any number)."""
    token = {"?": r"-?[0-9]+;", "+": r"(?:-?[0-9]+;)+?", "*": r"(?:-?[0-9]+;)*?"}
    regex = r"(?<![^;])" + "".join(token.get(p, f"{p};") for p in pattern)
    text = F.concat_ws("", F.transform("states", lambda x: F.concat(F.coalesce(x, F.lit(-1)).cast("string"), F.lit(";"))))
    return seq.select("id", F.regexp_count(text, F.lit(regex)).cast("long").alias("n"))


def random(spark, cases: int, length: int, states: int, seed: int = 1) -> DataFrame:
    """Sequences of uniform states, alike on every run."""
    cell = lambda t: F.pmod(F.xxhash64(F.lit(seed), F.col("id"), t), F.lit(states)).cast("int")
    return spark.range(cases).select("id", F.transform(F.sequence(F.lit(0), F.lit(length - 1)), cell).alias("states"))


def event_risks(seq: DataFrame, covariates: dict[str, DataFrame], org: int, des: int | None = None) -> DataFrame:
    """Person-periods of cases in org: id, t, event (1 if des, or any other known state, is next), and the state of each other sequence at t."""
    pairs = seq.where(F.size("states") > 1).select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size("states") - 1), lambda i: F.struct((i - 1).alias("t"), F.get("states", i - 1).alias("org"), F.get("states", i).alias("next")))).alias("_p")).select("id", "_p.*")
    hit = (F.col("next") >= 0) & (F.col("next") != F.col("org")) if des is None else F.col("next") == des
    out = pairs.where(F.col("org") == org).select("id", "t", F.when(hit, 1).otherwise(0).alias("event"))
    for name, other in covariates.items():
        out = out.join(to_long(other).withColumnRenamed("state", name), ["id", "t"], "left")
    return out


# distances between sequences


def data_costs(seq: DataFrame) -> dict[tuple[int, int], float]:
    """Substitution costs from transition shares: 2 - p(a to b) - p(b to a). As many as pairs of states."""
    p = {(r.org, r.des): r.share for r in transition_shares(seq, by_time=False).where("des >= 0").collect()}
    states = sorted({s for k in p for s in k})
    return {(a, b): 2 - p.get((a, b), 0.0) - p.get((b, a), 0.0) for a in states for b in states if a != b}


def _align(a: list[np.ndarray], b: list[np.ndarray], cost, indel: float, opening: float) -> np.ndarray:
    """Distances of every sequence of a to every one of b: the recursion runs over places, for all pairs at once."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    width_a, width_b = int(la.max(initial=0)), int(lb.max(initial=0))
    pad = lambda seqs, w: np.stack([np.pad(x, (0, w - len(x)), constant_values=-9) for x in seqs]) if w else np.zeros((len(seqs), 0), int)
    xa, xb = pad(a, width_a), pad(b, width_b)
    shape = (len(a), len(b))
    gap = lambda k: np.full(shape, (opening if k else 0.0) + indel * k)
    out = np.zeros(shape)
    row = [gap(j) for j in range(width_b + 1)]
    up = [np.full(shape, np.inf)] * (width_b + 1)  # best that ends in a gap in b

    def take(i: int, line: list[np.ndarray]) -> None:
        for k in np.flatnonzero(la == i):
            for m in range(shape[1]):
                out[k, m] = line[lb[m]][k, m]

    take(0, row)
    for i in range(1, width_a + 1):
        new, side = [gap(i)], np.full(shape, np.inf)
        new_up = [np.full(shape, np.inf)]
        for j in range(1, width_b + 1):
            sub = row[j - 1] + cost(xa[:, i - 1][:, None], xb[:, j - 1][None, :])
            u = np.minimum(row[j] + opening, up[j]) + indel
            side = np.minimum(new[j - 1] + opening, side) + indel
            new.append(np.minimum(sub, np.minimum(u, side)))
            new_up.append(u)
        row, up = new, new_up
        take(i, row)
    return out


def optimal_matching(seq: DataFrame, indel: float = 1.0, substitution: float | str | dict[tuple[int, int], float] = 2.0, opening: float = 0.0, block: int = 64) -> tuple[DataFrame, DataFrame]:
    """Least costs of turning one sequence into another: pairs (a, b, distance) of distinct sequences' numbers, and members (id, number).

    substitution: one cost, "difference" (of the states), or costs by pair (symmetric ones are looked up both ways). A gap of k places costs
    opening + k * indel. Missing states are left out. Equal sequences are compared once; distinct ones meet in pairs of blocks,
    and a task aligns all pairs of two blocks at once.
    """
    clean = seq.select("id", F.filter("states", lambda x: x >= 0).alias("states"))
    distinct = clean.groupBy("states").agg(F.min("id").alias("_id"))
    if dict(distinct.dtypes)["_id"] == "string":
        distinct = distinct.withColumn("_o", F.xxhash64("_id"))
    else:
        distinct = distinct.withColumn("_o", F.col("_id"))
    distinct = positions(distinct, "_o", "number").select("number", "states")
    members_ = clean.join(distinct, "states").select("id", "number")
    blocks = distinct.groupBy(F.floor((F.col("number") - 1) / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("number", "states"))).alias("rows"))
    meet = blocks.select(F.col("block").alias("block_a"), F.col("rows").alias("rows_a")).join(blocks.select(F.col("block").alias("block_b"), F.col("rows").alias("rows_b")), F.col("block_a") <= F.col("block_b"))
    table = dict(substitution) if isinstance(substitution, dict) else None

    def cost(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if table is not None:
            x, y = np.broadcast_arrays(x, y)
            return np.array([0.0 if p == q else table.get((p, q), table.get((q, p), np.inf)) for p, q in zip(x.ravel().tolist(), y.ravel().tolist())]).reshape(x.shape)
        return np.abs(x - y).astype(float) if substitution == "difference" else np.where(x == y, 0.0, float(substitution))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for own, ra, other, rb in zip(f["block_a"], f["rows_a"], f["block_b"], f["rows_b"]):
                na, nb = np.array([r["number"] for r in ra]), np.array([r["number"] for r in rb])
                d = _align([np.asarray(r["states"], int) for r in ra], [np.asarray(r["states"], int) for r in rb], cost, indel, opening)
                i, j = np.nonzero(na[:, None] < nb[None, :]) if own == other else np.nonzero(np.ones(d.shape, bool))
                yield pd.DataFrame({"a": na[i], "b": nb[j], "distance": d[i, j]})

    return meet.repartition(F.col("block_a"), F.col("block_b")).mapInPandas(run, "a long, b long, distance double"), members_

"""Episodes: rows with a start and an end, an origin and a destination state.

Columns: id, sn (number of the spell, from 1), org, des (equal to org: censored), ts, tf (0 <= ts < tf), and any others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("id", "sn", "org", "des", "ts", "tf")


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def define(df: DataFrame, ts, tf, org=0, des=1, id=None, sn=1, keep: Sequence[str] = ()) -> DataFrame:
    """Episodes from expressions or column names; what breaks the rules stays, so that invalid() can count it."""
    ident = F.lit(None).cast("long") if id is None else _c(id)
    return df.select(ident.alias("id"), _c(sn).cast("int").alias("sn"), _c(org).cast("int").alias("org"), _c(des).cast("int").alias("des"), _c(ts).cast("double").alias("ts"), _c(tf).cast("double").alias("tf"), *keep)


def valid() -> Column:
    return F.coalesce((F.col("ts") >= 0) & (F.col("ts") < F.col("tf")) & (F.col("org") >= 0) & (F.col("des") >= 0) & (F.col("sn") >= 1), F.lit(False))


def checked(episodes: DataFrame) -> DataFrame:
    return episodes.where(valid())


def invalid(episodes: DataFrame) -> DataFrame:
    """Counts of rows by what they break: negative_start, empty, bad_state, bad_number, missing."""
    c = F.col
    return episodes.agg(
        F.count("*").alias("rows"), F.count_if(c("ts") < 0).alias("negative_start"), F.count_if(c("ts") >= c("tf")).alias("empty"), F.count_if((c("org") < 0) | (c("des") < 0)).alias("bad_state"),
        F.count_if(c("sn") < 1).alias("bad_number"), F.count_if(c("ts").isNull() | c("tf").isNull() | c("org").isNull() | c("des").isNull()).alias("missing"),
    )


def transitions(episodes: DataFrame) -> DataFrame:
    """sn, org, des with the number of episodes, their summed duration and mean."""
    d = F.col("tf") - F.col("ts")
    return episodes.groupBy("sn", "org", "des").agg(F.count("*").alias("episodes"), F.sum(d).alias("duration"), F.avg(d).alias("mean_duration"))


def split(episodes: DataFrame, columns: Sequence[str] = (), times: Sequence[float] = ()) -> DataFrame:
    """Episodes cut at every distinct value of columns and times that is inside them; all pieces but the last are censored.

    A narrow transformation: cuts are sorted in an array of the row. split_no counts pieces from 1.
    """
    marks = F.array(*[F.col(c).cast("double") for c in columns], *[F.lit(float(t)) for t in times])
    inner = F.array_sort(F.array_distinct(F.filter(marks, lambda t: (t > F.col("ts")) & (t < F.col("tf")))))
    bounds = F.concat(F.array("ts"), inner, F.array("tf"))
    pieces = F.transform(F.sequence(F.lit(1), F.size("_b") - 1), lambda k: F.struct(k.alias("split_no"), F.element_at("_b", k).alias("a"), F.element_at("_b", k + 1).alias("b")))
    others = [c for c in episodes.columns if c not in ("des", "ts", "tf", "split_no")]
    out = episodes.withColumn("_b", bounds).select(*others, F.col("des").alias("_des"), F.size("_b").alias("_n"), F.explode(pieces).alias("_p"))
    last = F.col("_p.split_no") == F.col("_n") - 1
    return out.select(*others, F.when(last, F.col("_des")).otherwise(F.col("org")).alias("des"), F.col("_p.a").alias("ts"), F.col("_p.b").alias("tf"), F.col("_p.split_no").alias("split_no"))


def periods(episodes: DataFrame, points: Sequence[float]) -> DataFrame:
    """Episodes cut at points, with period: the number of the last point at or before the start, from 0.

    A period holds its first moment, not its last: an episode that ends with an event at a point has a piece without length there, and the event is its.
    """
    out = split(episodes, times=points)
    at_point = (F.col("des") != F.col("org")) & F.col("tf").isin([float(p) for p in points]) & (F.col("ts") < F.col("tf"))
    others = [c for c in out.columns if c not in ("des", "ts", "split_no")]
    piece = lambda des, ts, no: F.struct(des.alias("des"), ts.cast("double").alias("ts"), no.alias("split_no"))
    whole = piece(F.col("des"), F.col("ts"), F.col("split_no"))
    before, then = piece(F.col("org").cast(out.schema["des"].dataType), F.col("ts"), F.col("split_no")), piece(F.col("des"), F.col("tf"), F.col("split_no") + 1)
    out = out.select(*others, F.explode(F.when(at_point, F.array(before, then)).otherwise(F.array(whole))).alias("_p")).select(*others, "_p.*")
    place = F.lit(-1)
    for p in points:
        place = place + F.when(F.col("ts") >= float(p), 1).otherwise(0)
    return out.withColumn("period", place)


def states_at(episodes: DataFrame, times: Sequence[float]) -> DataFrame:
    """at, state, n: how many ids are in a state at each time, ts <= t < tf; of several spells of an id the first counts. State null: ids
    without a spell then. Times are a parameter; a row meets only those inside it."""
    inside = F.filter(F.array(*[F.lit(float(t)) for t in times]), lambda t: (t >= F.col("ts")) & (t < F.col("tf")))
    rows = episodes.select("id", "sn", "org", "ts", F.explode(inside).alias("at"))
    first = rows.groupBy("id", "at").agg(F.min(F.struct("ts", "sn", "org"))["org"].alias("state"))
    counts = first.groupBy("at", "state").agg(F.count("*").alias("n"))
    points = episodes.sparkSession.createDataFrame([(float(t),) for t in times], "at double")
    ids = episodes.agg(F.count_distinct("id").alias("_ids"))
    seen = points.join(counts.groupBy("at").agg(F.sum("n").alias("_n")), "at", "left").join(F.broadcast(ids))
    missing = seen.select("at", F.lit(None).cast("int").alias("state"), (F.col("_ids") - F.coalesce("_n", F.lit(0))).alias("n"))
    return counts.unionByName(missing)


def state_as_of(episodes: DataFrame, points: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """points (id, at) with the state (org) of the id's spell that holds at; null outside all spells.

    Both sides are laid out along time and the last start is carried forward, so no pair of a point and
    a spell is made beyond the one that counts.
    """
    names = points.columns
    left = points.select(*names, F.lit(1).alias("_kind"), F.col("at").cast("double").alias("_t"), F.lit(None).cast("struct<tf:double,org:int>").alias("_s"))
    right = episodes.select(*[F.col(c) if c == "id" else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in names], F.lit(0).alias("_kind"), F.col("ts").alias("_t"), F.struct("tf", "org").cast("struct<tf:double,org:int>").alias("_s"))
    w = Window.partitionBy("id").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = left.unionByName(right).withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where("_kind = 1")
    return out.select(*names, F.when(F.col("_t") < F.col("_s.tf"), F.col("_s.org")).alias("state"))


def from_events(events: DataFrame, id: str, time: str, state: str, end: Column | None = None) -> DataFrame:
    """Spells from dated events: a state lasts to the next event of the id; the last ends at end (a column or literal; without it, it is left
    out) and is censored. Events at the same time keep the order of their states."""
    w = Window.partitionBy(id).orderBy(time, state)
    rows = events.select(F.col(id).alias("id"), F.col(state).cast("int").alias("org"), F.col(time).cast("double").alias("ts"), F.lead(time).over(w).cast("double").alias("tf"), F.lead(state).over(w).cast("int").alias("des"), F.row_number().over(w).alias("sn"))
    if end is not None:
        rows = rows.withColumns({"tf": F.coalesce("tf", end.cast("double")), "des": F.coalesce("des", "org")})
    return rows.where(F.col("tf").isNotNull())

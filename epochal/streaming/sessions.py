"""Episodes from unbounded streams of events; the same functions take batches.

What a key holds between batches is one open spell, so state stays small whatever a key's number of events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, id: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """id, start, end, events: runs of events of an id with less than gap between them; events later than late behind the newest are dropped."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    got = rows.groupBy(F.col(id).alias("id"), F.session_window(time, gap).alias("_w")).agg(F.count("*").alias("events"))
    return got.select("id", F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "events")


def counts(events: DataFrame, time: str, state: str, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, end, state, n: the distribution of states over tumbling (or sliding) windows."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.groupBy(w.alias("_w"), F.col(state).alias("state")).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "state", "n")


SPELL = "id long, org int, des int, ts double, tf double"


def spells(events: DataFrame) -> DataFrame:
    """Spells as they end: id, org, des, ts, tf, from events id (long), state (int), time (double) that arrive in the order of time for each id. The open spell is kept
    as the state of its key; an event in the same state goes on with it."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        out = []
        for f in frames:
            for t, s in sorted(zip(f["time"], f["state"])):
                if now is None:
                    now = (int(s), float(t))
                elif s != now[0]:
                    if t > now[1]:
                        out.append((key[0], now[0], int(s), now[1], float(t)))
                    now = (int(s), float(t))
        if now is not None:
            state.update(now)
        yield pd.DataFrame(out, columns=["id", "org", "des", "ts", "tf"])

    return events.select("id", "state", "time").groupBy("id").applyInPandasWithState(step, SPELL, "state int, since double", "append", GroupStateTimeout.NoTimeout)

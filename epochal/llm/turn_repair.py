"""Repair of conversations' turns by a fold of Spark's own functions.

Windows give each turn its first fault; sorted structs of a conversation's turns are folded by aggregate(), which carries the
cheapest edits to each of four states: nothing yet, after a system turn, after a user turn, after an assistant turn. A state is a
struct (cost, audit), and least() takes the cheaper, then the ASCII-least. The next role is always told by the state, so the
audit alone gives the repaired turns. A conversation must fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

#: The costs of rewriting a role, deleting a turn, inserting one, and of what stays truncated.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: More than any repair costs: the states that no edits have reached.
_NEVER = 10**15


def faults(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text; no nulls in role and text) with at, the place in the conversation, and fault: blank, duplicate,
    truncated or null; the first that holds.

    Order: turn, nulls first; equal ones by role, then text.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    seen = Window.partitionBy("conv_id", "role", "text").orderBy("at")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "blank").when(F.row_number().over(seen) > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return turns.withColumn("at", F.row_number().over(order)).withColumn("fault", fault)


def _state(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _edit(state: Column, cost: Column | int, letter: str) -> Column:
    return _state(state["cost"] + cost, F.concat(state["audit"], F.lit(letter)))


def _inserted(states: Column) -> tuple[Column, Column]:
    """The states after a user and after an assistant turn, with turns inserted where that is cheaper."""
    user = F.least(states["user"], *[_edit(states[s], INSERT, "I") for s in ("start", "system", "assistant")])
    return user, F.least(states["assistant"], _edit(user, INSERT, "I"))


def _after(states: Column, row: Column) -> Column:
    """The states after one more turn: kept, given another role, or deleted."""
    user, assistant = _inserted(states)
    start, system, who = states["start"], states["system"], row["who"]
    never = F.lit(_NEVER)
    stays = F.when(row["fault"].isin("blank", "duplicate"), never).when(row["fault"] == "truncated", TRUNCATED).otherwise(0)
    kept = lambda letter: F.when(who == letter, stays).otherwise(never)
    to_user = [e for s in (start, system, assistant) for e in (_edit(s, kept("u"), "K"), _edit(s, stays + REROLE, "R"))]
    gone = lambda s: _edit(s, DELETE, "D")
    return F.struct(
        gone(start).alias("start"),
        F.least(gone(system), _edit(start, kept("s"), "K")).alias("system"),
        F.least(gone(user), *to_user).alias("user"),
        F.least(gone(assistant), _edit(user, kept("a"), "K"), _edit(user, stays + REROLE, "R")).alias("assistant"),
    )


def repaired(turns: DataFrame) -> DataFrame:
    """A row for each conversation of turns (conv_id, turn, role, text): counts of faults and gaps, the cheapest repair and its turns.

    conv_id, gaps, blank, duplicate, truncated, illegal (adjacent roles that can't follow one another), cost, audit (a letter for each edit:
    Keep, Rerole, Delete, Insert), repaired (array of role:text). Null roles and texts count as one space; a null conv_id is a conversation too;
    null turns come first, equal turns are ordered by role, then text; repeated rows are turns of their own. Other columns are ignored. No
    turns, no row.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = faults(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text")))
    order = Window.partitionBy("conv_id").orderBy("at")
    pair = F.concat(F.lag(F.left("role", F.lit(1))).over(order), F.left("role", F.lit(1)))
    before = F.lag("turn").over(order)
    new = F.col("turn").isNotNull() & (before.isNull() | (before != F.col("turn")))
    rows = rows.withColumns({"illegal": ~pair.isin("su", "ua", "au"), "new": new})
    count = lambda what: F.count_if(F.col("fault") == what).alias(what)
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_if("new")
    convs = rows.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).alias("gaps"), count("blank"), count("duplicate"), count("truncated"), F.count_if("illegal").alias("illegal"),
        F.sort_array(F.collect_list(F.struct("at", F.left("role", F.lit(1)).alias("who"), "fault", "role", "text"))).alias("rows"),
    )
    never = _state(F.lit(_NEVER), F.lit(""))
    begin = F.struct(_state(F.lit(0), F.lit("")).alias("start"), never.alias("system"), never.alias("user"), never.alias("assistant"))
    best = F.aggregate("rows", begin, _after, lambda s: F.least(s["start"], _inserted(s)[1]))
    convs = convs.withColumn("best", best).withColumns({"cost": F.col("best.cost"), "audit": F.col("best.audit")})
    return convs.withColumn("repaired", _turns()).drop("rows", "best")


def _turns() -> Column:
    """role:text of the repaired turns, from rows and audit. A kept or rewritten row is a token of the audit with the insertions before it."""
    edits = F.regexp_replace("audit", "D", "")
    deleted = F.regexp_extract_all("audit", F.lit("[KRD]"), F.lit(0))
    stay = F.filter(F.arrays_zip(F.col("rows"), deleted.alias("edit")), lambda x: x["edit"] != "D")
    tokens = F.regexp_extract_all(edits, F.lit("I*[KR]"), F.lit(0))
    # how many turns stand before each token: only whether that is even counts, so one letter for each token is carried
    odd = F.aggregate(tokens, F.lit("0"), lambda had, t: F.concat(had, ((F.right(had, F.lit(1)).cast("int") + F.length(t)) % 2).cast("string")))
    system = (F.get(stay, F.lit(0))["rows"]["who"] == "s") & edits.startswith("K")
    first = F.when(F.coalesce(system, F.lit(False)), 1).otherwise(0)
    role = lambda place: F.when((place + first) % 2 == 0, "user").otherwise("assistant")

    def told(x: Column) -> Column:
        t, before, row = x["t"], x["before"].cast("int"), x["row"]
        letter = lambda k: F.substring(t, k + 1, 1)
        return F.transform(
            F.sequence(F.lit(0), F.length(t) - 1),
            lambda k: F.when(letter(k) == "I", F.concat(role(before + k), F.lit(":")))
            .when(letter(k) == "R", F.concat(role(before + k), F.lit(":"), row["text"]))
            .otherwise(F.concat(row["role"], F.lit(":"), row["text"])),
        )

    places = F.transform(tokens, lambda t, k: F.struct(t.alias("t"), F.substring(odd, k + 1, 1).alias("before"), F.get(stay, k)["rows"].alias("row")))
    body = F.flatten(F.transform(places, told))
    more = F.length(F.regexp_extract(edits, "(I*)$", 1))
    tail = F.when(more > 0, F.transform(F.sequence(F.lit(0), more - 1), lambda k: F.concat(role(F.size(body) + k), F.lit(":")))).otherwise(F.array().cast("array<string>"))
    return F.concat(body, tail)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations (conv_id, turn, role, text) with the faults that crc32 of conv_id:turn, modulo 20, tells: 0 drops a row, 1 empties its
    text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes the role user. Nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20).alias("kind")
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind).where("kind <> 0")
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")

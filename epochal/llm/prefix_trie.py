"""The trie of conversation prefixes, built level by level.

At each depth the conversations that still share their node with another are grouped by (parent node, next turn); a group is
a node, named by its smallest conversation. A conversation alone at a node is a chain from there on and leaves the rounds.
Joins from the deepest level upwards then add up leaves and savings. Turns are told apart by a SHA-256 digest of role and text,
so no text moves after the first pass. Every level is a table in the shared folder.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import discard, settled, shared_dir
from .common import WORD

#: Turn numbers are ranked in chunks of so many, so that a very long conversation isn't one group.
CHUNK = 4096
#: A group with more than this part of a level's conversations is hot; fewer than HOT groups are, and those are broadcast.
HOT = 256

_LEVEL = "depth long, node long, parent long, n_convs long, tokens long, len long"
_ROLLED = "depth long, node long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def coded(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), digest and tokens (words of the text) of each turn.

    Null turns come first; equal ones are ordered by role, then by digest. Null roles and texts are empty. Rows without a
    conversation are left out; repeated rows are turns of their own. Other columns are ignored.
    """
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, what), 256))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), who.alias("role"), digest.alias("digest"),
        F.regexp_count(what, F.lit(WORD)).cast("long").alias("tokens"),
    ).withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    rows = settled(rows)
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    before = Window.partitionBy("conv_id").orderBy(F.col("chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("pos", F.row_number().over(inside).cast("long"))
    chunks = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
    skips = chunks.where("skip > 0").select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "skip")
    on = (F.col("conv_id") == F.col("c")) & F.col("chunk").eqNullSafe(F.col("k"))
    return ranked.join(skips, on, "left").select("conv_id", (F.col("pos") + F.coalesce("skip", F.lit(0))).alias("pos"), "digest", "tokens")


def spliced(turns: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another: conversation c takes the first h turns of c - c % every instead of its own first h,
    h being crc32(c) % (most + 1). Turns as coded() gives them, and conv_id and len of every conversation, turnless ones too."""
    turns = settled(turns)
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    own_h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most + 1))
    convs = n.withColumns({"h": own_h, "donor": F.col("conv_id") - F.col("conv_id") % every})
    convs = convs.join(n.select(F.col("conv_id").alias("donor"), F.col("n").alias("dn")), "donor", "left")
    convs = settled(convs.withColumn("taken", F.least("h", F.coalesce("dn", F.lit(0)))))
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "tokens")
    given = convs.where("taken > 0").select("conv_id", "donor", "taken").join(turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "donor"), "donor")
    out = own.unionByName(given.where("pos <= taken").select("conv_id", "pos", "digest", "tokens"))
    return out, convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))


def trie(turns: DataFrame, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of the trie of all prefixes.

    turns: conv_id, pos (1 to len), digest, tokens. conversations: conv_id (unique), len; those of no turns end at the root.
    Nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. A node's text is turn
    depth of conversation conv_id. Ends: depth, node and conv_id of every conversation's last node. No conversations, no rows.
    """
    spark = turns.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/trie-{uuid.uuid4().hex}"
    turns = settled(turns.repartition("conv_id").sortWithinPartitions("pos"))  # a level's scan skips the row groups of others
    members = settled(conversations.select("conv_id", "len"))
    least, n = members.agg(F.min("conv_id"), F.count("*")).first()
    if not n:
        nodes = spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
        return nodes, spark.createDataFrame([], "depth long, node long, conv_id long")

    def level(df: DataFrame, depth: int) -> DataFrame:
        df.select(F.lit(depth).cast("long").alias("depth"), "node", "parent", "n_convs", "tokens", "len").write.parquet(f"{base}/level-{depth}")
        return spark.read.schema(_LEVEL).parquet(f"{base}/level-{depth}")

    null = F.lit(None).cast("long")
    levels = [level(spark.range(1).select(F.lit(least).alias("node"), null.alias("parent"), F.lit(n).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("tokens"), null.alias("len")), 0)]
    state, live, groups = members.select("conv_id", "len", F.lit(least).alias("node")), None, None
    while True:
        depth = len(levels) - 1
        ended = state.where(F.col("len") == depth)
        ended.select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id").write.mode("append").parquet(f"{base}/ends")
        here = turns.where(F.col("pos") == depth + 1).select("conv_id", "digest", "tokens")
        live = settled(state.where(F.col("len") > depth).join(here, "conv_id").select("conv_id", "len", F.col("node").alias("parent"), "digest", "tokens"), live)
        n = live.count()
        if groups is not None:
            discard(groups)
        if not n:
            break
        groups = settled(live.groupBy("parent", "digest").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("tokens").alias("tokens"), F.max("len").alias("len")))
        levels.append(level(groups, depth + 1))
        shared, is_hot = groups.where("n_convs > 1"), F.col("n_convs") * HOT > n
        hot = shared.where(is_hot).select("parent", "digest", F.col("node").alias("hot"))  # fewer than HOT rows
        marked = live.join(F.broadcast(hot), ["parent", "digest"], "left")
        cold = marked.where("hot IS NULL").drop("hot").join(shared.where(~is_hot).select("parent", "digest", "node"), ["parent", "digest"])
        state = cold.select("conv_id", "len", "node").unionByName(marked.where("hot IS NOT NULL").select("conv_id", "len", F.col("hot").alias("node")))
    below = None
    for depth in range(len(levels) - 1, -1, -1):
        own = levels[depth].where(F.lit(depth == 0) | (F.col("n_convs") > 1))
        if below is None:
            own = own.withColumns({c: F.lit(None).cast("long") for c in ("n_children", "leaves", "saved")})
        else:
            own = own.join(below, "node", "left")
        rolled = own.select(
            "depth", "node", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("tokens") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        )
        rolled.write.parquet(f"{base}/rolled-{depth}")
        if depth:
            rolled = spark.read.schema(_ROLLED).parquet(f"{base}/rolled-{depth}")
            alone = levels[depth].where("n_convs = 1").select(F.col("parent").alias("node"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
            kids = rolled.select(F.col("parent").alias("node"), "n_leaves", "saved_tokens").union(alone)
            below = kids.groupBy("node").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    depths = range(len(levels))
    inner = spark.read.schema(_ROLLED).parquet(*[f"{base}/rolled-{d}" for d in depths])
    starts = spark.read.schema(_LEVEL).parquet(*[f"{base}/level-{d}" for d in depths]).where("depth > 0 AND n_convs = 1")
    chain = turns.join(starts.select(F.col("node").alias("conv_id"), "depth", "parent", "len"), "conv_id").where("pos >= depth")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    chain = chain.select(
        "conv_id", F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(F.col("pos") < F.col("len"), 1).otherwise(0).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
    )
    nodes = inner.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens").unionByName(chain)
    ends = spark.read.schema("depth long, node long, conv_id long").parquet(f"{base}/ends")
    ends = ends.unionByName(starts.select(F.col("len").alias("depth"), "node", F.col("node").alias("conv_id")))
    discard(live)
    return nodes, ends


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, node and ends_sha256: the SHA-256 of the node's ids in ascending order, joined by commas.

    Ids meet in lists of up to CHUNK neighbouring ones; a node of several lists hashes them one after another, in order, without holding them.
    """
    key = ["depth", "node"]
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    parts = settled(ends.groupBy(*key, F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(ids.alias("ids")))
    lists = parts.groupBy(*key).agg(F.count("*").alias("lists"), F.first("ids").alias("ids"))
    short = lists.where("lists = 1").select(*key, F.sha2("ids", 256).alias("ends_sha256"))
    long_ = parts.join(lists.where("lists > 1").select(*key), key, "left_semi")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sha, out = None, None, []
        for f in frames:
            for depth, node, ids in zip(f["depth"], f["node"], f["ids"]):
                if (depth, node) == at:
                    sha.update(b",")
                else:
                    if at is not None:
                        out.append((*at, sha.hexdigest()))
                    at, sha = (depth, node), hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield pd.DataFrame(out, columns=[*key, "ends_sha256"])
                out = []
        if at is not None:
            yield pd.DataFrame([(*at, sha.hexdigest())], columns=[*key, "ends_sha256"])

    streamed = long_.repartition(*key).sortWithinPartitions(*key, "chunk").mapInPandas(run, "depth long, node long, ends_sha256 string")
    return short.unionByName(streamed)

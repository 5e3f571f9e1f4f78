"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; every document of a source then expects the same
number of copies. Along the source's documents, ordered by size, expected copies are summed,
one offset per source is added, and a document is emitted once per integer boundary crossed.
Only ids, sources and sizes are ranked; texts meet their copies at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep

#: The order along a source: CLASSES of sizes for each doubling, SALTS of each class by a hash, then size. Ranks are
#: taken inside a salt, and added to the rows before it.
CLASSES, SALTS = 16, 64


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources: source, source_size. Adds weight and target.

    Sources by code point, null last, weigh the weights in turn; together they get share of
    all sizes; none gets more than cap times its size, and what is above is reshared by weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    out = sources.withColumn("weight", F.element_at(F.array([F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    out = out.withColumns({"_all": F.lit(share) * F.sum("source_size").over(whole), "_most": F.lit(float(cap)) * F.col("source_size")})
    # in the order of most / weight, the sources that end at their most come first
    filling = Window.orderBy(F.col("_most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = out.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    out = out.withColumn("_full", F.col("_most") <= F.col("_level") * F.col("weight"))
    entire = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("_level", F.first(F.when(~F.col("_full"), F.col("_level")), ignorenulls=True).over(entire))
    target = F.when(F.col("_full"), F.col("_most")).otherwise(F.col("weight") * F.col("_level"))
    return out.select("source", "source_size", "weight", target.alias("target"))


def with_copies(docs: DataFrame, size: str = "size", source: str = "source", key: tuple[str, ...] = ("doc_id",), seed: int = 7, **mix) -> DataFrame:
    """docs with source_size, target (of its source) and copies (times that the mix emits it). docs is written once and
    should have no texts.

    Needs a long column size. Null sources are a source of their own. A source of no words
    gets no copies. Rows alike in key and size may change places. Columns named source_size,
    target or copies are replaced. An empty table gives an empty result. No source is ranked in one task, nor documents of
    one size; rows of one key are.
    """
    names = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    hashed = F.xxhash64(F.lit(seed), *(F.col(k).cast("string") for k in key))
    docs = docs.select(F.struct(*names).alias("_row"), F.col(source).alias("source"), F.col(size).alias("size"), F.struct(*key).alias("key"), F.floor(F.log2(F.col(size) + 1.0) * CLASSES).cast("int").alias("class"), hashed.alias("hash"))
    docs = keep(docs.withColumn("salt", F.pmod("hash", F.lit(SALTS)).cast("int")))
    cells = keep(docs.groupBy("source", "class", "salt").agg(F.count("*").alias("rows"), F.sum("size").alias("sizes")))  # a bounded number for each source
    sources = targets(cells.groupBy("source").agg(F.sum("sizes").alias("source_size")), **mix)
    before = Window.partitionBy("source").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).alias("c").join(sources.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
    cells = cells.select(F.col("c.source").alias("_source"), F.col("c.class").alias("_class"), F.col("c.salt").alias("_salt"), "before", "source_size", "target")
    docs = docs.join(cells, F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class")) & (F.col("salt") == F.col("_salt")))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("source", "class", "salt").orderBy("size", "hash", "key"))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("source")), F.lit(1 << 40)) / float(1 << 40)
    docs = docs.select("_row", "source_size", "target", rank.alias("rank"), each.alias("each"), offset.alias("offset"))
    copies = F.floor(F.col("each") * F.col("rank") + F.col("offset")) - F.floor(F.col("each") * (F.col("rank") - 1) + F.col("offset"))
    return docs.select("_row.*", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """The mixed documents themselves: every row of docs as often as the mix emits it, with its own columns.

    Null texts have no words and are emitted like any text. Of rows alike in key and text one stands for all,
    as often as they are emitted together. Reruns agree. An empty table gives an empty result.
    """
    name = lambda c: F.col(c).alias("key")
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())
    narrow = docs.select(name(key), F.col(source).alias("source"), n_words(text).alias("size"), hashed.alias("hash"))
    emitted = keep(with_copies(narrow, key=("key", "hash"), **how).select("key", "hash", "copies"))
    several = keep(emitted.groupBy("key", "hash").count().where("count > 1"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), name(key), hashed.alias("hash"))
    same = lambda a, b: a["key"].eqNullSafe(b["key"]) & (a["hash"] == b["hash"])
    if not several.isEmpty():
        once = rows.join(several, same(rows, several), "left_semi").groupBy("key", "hash").agg(F.first("_row").alias("_row")).select("_row", "key", "hash")
        rows = rows.join(several, same(rows, several), "left_anti").union(once)
    out = emitted.where("copies > 0").select("key", "hash", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
    return rows.join(out, same(rows, out)).select("_row.*")

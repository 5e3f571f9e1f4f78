"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

Tokens of the templates are ordered by how many documents hold them, rarest first. Blocks are lines
and, as notices are wrapped, overlapping windows of words for each length of a template: twice as many words as it has, beginning
every so many as it has. A block contains a template if it holds enough of its distinct tokens; windows are compared
with the templates of their length. A block with a template must hold one of the template's first tokens (prefix filter), have enough tokens (length filter)
and enough room behind the first shared one (positional filter). What passes is verified.
DataFrame functions only; templates are a bounded list.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, keep

WORDS = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: Phrase and label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Label and text of the templates that blocks are compared with.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under the creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
)
THRESHOLD = 0.8


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORDS), F.lit(0))


def _strings(values) -> Column:
    return F.array([F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of the phrases, first_word and last_word are their smallest and
    largest starts (null if none). labels joins the phrases' labels with those of the templates
    that a block contains; score is the largest containment reached, 0 if none. Labels are
    distinct, sorted and comma-joined, empty if there are none. A null text counts as empty.
    Repeated rows get the same; other columns are ignored; an empty table gives an empty result.
    """
    sets, lengths = [(label, sorted(set(text.split()))) for label, text in templates], [len(text.split()) for _, text in templates]
    need = [math.ceil(threshold * len(s) - 1e-9) for _, s in sets]
    universe = sorted({t for _, s in sets for t in s})
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), _tokens(text).alias("_words"))
    step = step.withColumn("_present", F.array_intersect(_strings(universe), F.col("_words")))
    # a document can hold a block of a template only if the whole holds as many of its tokens
    can = F.lit(False)
    for (_, s), k in zip(sets, need):
        can = can | (F.size(F.array_intersect("_present", _strings(s))) >= k)
    hits = F.lit(False)
    word = lambda i, k: F.get(F.col("_words"), i + k)
    fits = lambda i: [F.coalesce(_all(word(i, k) == w for k, w in enumerate(p.split())), F.lit(False)) for p, _ in phrases]
    for p, _ in phrases:
        hits = hits | _all(F.array_contains("_words", w) for w in p.split())
    n = F.size("_words")
    places = F.when(hits, F.filter(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("at"), F.array(*[F.when(c, label) for c, (_, label) in zip(fits(i), phrases)]).alias("of"))), lambda x: F.exists(x["of"], lambda y: y.isNotNull())))
    step = step.select("_id", n.cast("long").alias("n_words"), places.alias("_places"), "_present", F.when(can, F.col("_text")).alias("_text"), F.xxhash64("_text").alias("_hash"))
    found = F.flatten(F.transform("_places", lambda x: F.filter(x["of"], lambda y: y.isNotNull())))
    at = F.transform("_places", lambda x: x["at"])
    step = step.select(
        "_id", "n_words", F.coalesce(F.size(found), F.lit(0)).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.coalesce(F.array_sort(F.array_distinct(found)), _strings([])).alias("_base"), "_present", "_text", "_hash",
    ).withColumn("n_base", F.when(F.col("n_base") < 0, 0).otherwise(F.col("n_base")))
    kept = keep(step)

    held = {r[0]: r[1] for r in kept.select(F.explode("_present").alias("t")).groupBy("t").count().collect()}  # as many as the templates have tokens
    order = sorted(universe, key=lambda t: (held.get(t, 0), t))
    place = {t: k for k, t in enumerate(order)}
    index = [(t, k, i, label, len(s), least, sorted(s, key=place.get), long) for k, ((label, s), least, long) in enumerate(zip(sets, need, lengths)) for i, t in enumerate(sorted(s, key=place.get)[: len(s) - least + 1])]
    prefixes = docs.sparkSession.createDataFrame(index or [("", 0, 0, "", 1, 1, [""], 1)], "_token string, _template int, _i int, _label string, _size int, _least int, _set array<string>, _length int")
    block = lambda tokens, window: F.struct(F.array_distinct(tokens).alias("all"), F.lit(window).alias("window"))
    lines = F.transform(F.filter(F.split("_text", "\n"), lambda x: x != ""), lambda x: block(_tokens(x), 0))
    starts = lambda k: F.sequence(F.lit(1), F.greatest(F.size("_words"), F.lit(1)), F.lit(k))
    across = lambda k: F.transform(starts(k), lambda i: block(F.slice("_words", i, 2 * k), k))
    windows = [across(k) for k in sorted(set(lengths))]
    blocks = kept.where("_text is not null").select("_id", "_hash", "_text", _tokens(F.col("_text")).alias("_words")).select("_id", "_hash", F.explode(F.concat(lines, *windows)).alias("_block"))
    blocks = blocks.select("_id", "_hash", F.col("_block.all").alias("_all"), F.col("_block.window").alias("_window")).withColumn("_ordered", F.array_intersect(_strings(order), F.col("_all")))
    blocks = blocks.select("_id", "_hash", "_window", F.size("_all").alias("_n"), "_ordered", F.posexplode("_ordered").alias("_j", "_token"))
    near = blocks.join(F.broadcast(prefixes), "_token")  # as many rows as the templates have prefix tokens
    near = near.where(F.col("_window").isin(0) | (F.col("_window") == F.col("_length"))).where((F.col("_n") >= F.col("_least")) & (1 + F.least(F.col("_size") - F.col("_i"), F.size("_ordered") - F.col("_j")) - 1 >= F.col("_least")))
    near = near.withColumn("_share", F.size(F.array_intersect("_ordered", "_set"))).where("_share >= _least")
    near = near.groupBy("_id", "_hash").agg(F.collect_set("_label").alias("_more"), F.max(F.col("_share") / F.col("_size")).alias("score"))
    near = near.select(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"), "_more", "score")
    out = kept.drop("_present", "_text").join(near, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_more", _strings([]))))
    return out.select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out

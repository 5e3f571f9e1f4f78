"""Quality rules as a short-circuit cascade, in DataFrame functions only.

On a sample, each rule's cost and the share it rejects are estimated; rules are then asked
in the order of rejection per cost, and a document meets a rule only if those before it
let it pass. The order decides the cost alone: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, free

SYMBOLS, _SPACE = "#*$%&|<>", r"\x20\x09-\x0D"
#: Rows of the sample, about, at any size of the table, and the partitions that they are spread over.
SAMPLE_ROWS, SAMPLE_PARTS = 2000, 8

#: From a word's start on, so that none is looked at from each of its characters.
LONG_WORD = rf"(?<![^{_SPACE}])[^{_SPACE}]{{41,}}+"

Rule = Callable[[str], Column]


def _words(text: str) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def _of(text: Column | str, others: str) -> Column:
    """How many characters are left without runs of others, a class: regexp_count would make a string of each."""
    return F.length(F.regexp_replace(text, f"{others}+", ""))


def _letters(text: str) -> Column:
    return _of(text, r"\P{L}")


def _beyond(some: Column, count: Column, share: float, text: str) -> Column:
    """count, which is 0 unless some, is over that share of the words; these are counted only then."""
    return some & (count > share * _words(text))


def _lines(text: str) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


#: Name: the condition under which a non-null text is rejected. Each needs the text alone.
RULES: dict[str, Rule] = {
    "few_words": lambda t: _words(t) < 20,
    "symbols": lambda t: _beyond(F.col(t).rlike(f"[{SYMBOLS}]"), _of(t, f"[^{SYMBOLS}]"), 0.1, t),
    "repeated_lines": lambda t: F.size(_lines(t)) - F.size(F.array_distinct(_lines(t))) > 0.3 * F.size(_lines(t)),
    "exclamations": lambda t: _beyond(F.contains(F.col(t), F.lit("!")), _of(t, "[^!]"), 0.3, t),
    "capitals": lambda t: _of(t, r"\P{Lu}") > 0.5 * _letters(t),
    "few_letters": lambda t: _letters(t) < 0.5 * _of(t, f"[{_SPACE}]"),
    "long_words": lambda t: _beyond(F.col(t).rlike(LONG_WORD), F.regexp_count(t, F.lit(LONG_WORD)), 0.1, t),
}


def plan(docs: DataFrame, rules: dict[str, Rule] = RULES, text: str = "text", seed: int = 11) -> list[tuple[str, float, float]]:
    """(name, seconds on the sample, share rejected), by rejection per cost. The sample serves the order only."""
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    sample = docs.select(F.coalesce(text, F.lit("")).alias("t")).sample(share, seed).repartition(SAMPLE_PARTS).persist()
    try:
        rows = max(1, sample.count())
        took = []
        for name, rule in rules.items():
            began = time.perf_counter()
            rejected = sample.agg(F.count_if(rule("t"))).first()[0]
            took.append((name, time.perf_counter() - began, (rejected or 0) / rows))
    finally:
        sample.unpersist()
    least = min((s for _, s, _ in took), default=0) * 0.9  # what any job takes
    took = [(n, s - least, r) for n, s, r in took]
    return sorted(took, key=lambda x: -(x[2] + 1e-6) / x[1])


def first_failed(order: list[str], rules: dict[str, Rule] = RULES, text: str = "text") -> Column:
    """Name of the first rule in order that rejects text, else null; later rules aren't evaluated."""
    out = F.lit(None).cast("string")
    for name in reversed(order):
        out = F.when(rules[name](text), name).otherwise(out)
    return out


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long).

    A null, empty or wordless text has none of each; texts of any length are measured whole, repeated rows alike, and an empty
    table gives an empty result. Windows of eight words are compared by 64-bit hashes of hashes of halves. Columns of docs that have one of these
    five names are replaced; others keep their values, whatever they are called.
    """
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    names = docs.columns
    words, split, wins, sides, found = (free(c, names) for c in ("_words", "_lines", "_windows", "_sides", "_found"))
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    step = docs.withColumns({words: F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), "n_symbols": _of(t, f"[^{SYMBOLS}]").cast("long"), split: lines})
    n = F.size(words)
    step = step.select(
        *names,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size(split) - F.size(F.array_distinct(split))).cast("long").alias("n_dup_lines"),
        F.transform(words, lambda x: F.xxhash64(x)).alias(wins),
    )
    for k in (1, 2, 4):  # of words, pairs, fours, eights
        rest = F.greatest(F.size(wins) - k, F.lit(0))
        step = step.withColumn(wins, F.zip_with(F.slice(wins, F.lit(1), rest), F.slice(wins, F.lit(k + 1), rest), lambda x, y: F.xxhash64(x, y)))
    repeats = F.size(F.array_distinct(wins)) < F.size(wins)
    # where a text repeats a window: hashes with their places, sorted, so that equals stand side by side
    step = step.withColumn(sides, F.when(repeats, F.array_sort(F.transform(wins, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))))
    size = F.size(sides)
    at = lambda j: F.get(sides, j)["h"]
    twice = F.filter(F.sequence(F.lit(0), size - 1), lambda j: (F.coalesce(at(j) == at(j - 1), F.lit(False))) | (F.coalesce(at(j) == at(j + 1), F.lit(False))))
    step = step.withColumn(found, F.when(F.col(sides).isNotNull(), F.array_sort(F.transform(twice, lambda j: F.get(sides, j)["p"]))))
    k = F.size(found)
    gaps = F.zip_with(F.slice(found, 1, k - 1), F.slice(found, 2, k - 1), lambda a, b: F.least(b - a, F.lit(8)))
    covered = F.when(k > 0, F.aggregate(gaps, F.lit(8), lambda s, x: s + x)).otherwise(0)
    return step.withColumn("n_repeat_words", covered.cast("long")).select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judged(docs: DataFrame, text: str = "text", rules: dict[str, Rule] = RULES) -> DataFrame:
    """docs with the five measures, base_failed (under 20 words, or over 30 % of them in repeated windows),
    failed_rule and kept. Null texts fail as empty ones; repeated rows are judged alike; an empty
    table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("base_failed", "failed_rule", "kept", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    order = [n for n, _, _ in plan(docs, rules, text)]
    whole = free("_text", docs.columns)
    filled = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    filled = filled.withColumn("failed_rule", first_failed(order, rules, whole)).drop(whole)
    out = measures(filled, text)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = out.withColumn("base_failed", base)
    # were it deterministic, a filter by kept would be pushed below the measures, and all of them copied into it over and over
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull() & (F.monotonically_increasing_id() >= 0))
    return out.select(*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule", "kept")


def accepted(docs: DataFrame, text: str = "text", rules: dict[str, Rule] = RULES) -> DataFrame:
    """The rows of docs, with its own columns, that judged() keeps: whatever these are called. Null, empty and wordless texts
    go; repeated rows stay or go together; an empty table gives an empty result."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("text"))  # no name of docs can clash
    return judged(rows, "text", rules).where("kept").select("_row.*")

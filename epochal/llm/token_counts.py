"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, offline, by merging
each of them. A pre-token found among them counts one; only the rest is merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import blocks, merge_all
from .bytebpe import ByteBpe, pieces

#: Pieces whose counts a worker keeps; it starts anew when full, which changes no result.
KEPT_PIECES = 300_000
_counters: dict[str, Counter] = {}


def whole_tokens(bpe: ByteBpe) -> frozenset[bytes]:
    """The vocabulary strings that merging turns into their own single token."""
    special = set(bpe.added.values())
    return frozenset(t for i, t in bpe.tokens.items() if i not in special and bpe.merge(t) == [i])


class Counter:
    def __init__(self, bpe: ByteBpe, whole: frozenset[bytes]):
        self.bpe, self.whole, self.kept = bpe, whole, {}

    def count(self, texts: list[str]) -> list[int]:
        if len(self.kept) >= KEPT_PIECES:
            self.kept.clear()
        kept, parted, new = self.kept, [], {}
        for text in texts:
            segments = self.bpe.segments(text)
            parted.append((len(segments) // 2, lists := [pieces(x) for x in segments[::2]]))
            for x in lists:
                x[0] = "\0" + x[0]  # without an opening space
                new.update([(p, None) for p in x if p not in kept])
        self._new(list(new))
        n = [special + sum([sum(map(kept.__getitem__, x)) for x in lists]) for special, lists in parted]
        for x in new:
            if len(x) > 64:
                del kept[x]
        return n

    def _new(self, found: list[str]) -> None:
        whole, split, rest, owner, n = self.whole, self.bpe.pre_tokens, [], [], [0] * len(found)
        for k, x in enumerate(found):
            for word in split(x[1:] if x[:1] == "\0" else " " + x):
                if (word := word.encode()) in whole:
                    n[k] += 1
                else:
                    rest.append(word)
                    owner.append(k)
        _, ends = merge_all(rest, self.bpe)
        more = np.bincount(np.array(owner, np.int64), np.diff(ends), len(found)).astype(np.int64)
        self.kept.update(zip(found, (more + np.array(n, np.int64)).tolist()))


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row for each row of docs: its id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens); an empty table gives an empty result;
    repeated rows and ids are counted each; other columns are ignored. Texts are taken
    whole. The vocabulary, whose size doesn't depend on the data, is sent to the executors.
    """
    spark = docs.sparkSession
    bpe = ByteBpe.load(tokenizer)
    tables = spark.sparkContext.broadcast((bpe, whole_tokens(bpe)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(tokenizer)
        if counter is None:
            counter = _counters[tokenizer] = Counter(*tables.value)
        for batch in batches:
            n = [x for block in blocks([t or "" for t in batch.column(1).to_pylist()]) for x in counter.count(block)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

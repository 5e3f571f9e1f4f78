"""Exact duplicates by a minimal perfect hash over the digests of earlier documents.

The history's distinct SHA-256 digests are dealt into shards by their first bits. A shard is one row: a minimal perfect hash
in levels of bits, and for each slot the whole digest, the winner's locator and the number of copies. A new batch is first
grouped by digest, so that a text costs one lookup whatever its copies; a lookup goes to one slot, and only equality of all 32
bytes makes it a member. Nonmembers are groups of their own. Members add to their slot, whose winner may change.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Digests a shard holds on average, whatever the corpus: about 6 MB.
SHARD = 100_000
#: Bits of a level for each digest that comes to it, and levels at most; what is left then is kept sorted.
SPREAD, LEVELS = 2, 40
#: A group of more than this part of all rows is hot; fewer than HOT are, and those are broadcast.
HOT = 256


def _mixed(words: np.ndarray, level: int) -> np.ndarray:
    """64 bits of each digest (four words), others at each level."""
    x = np.zeros(len(words), np.uint64)
    for k in range(4):
        x = (x ^ words[:, k] ^ np.uint64(0x9E3779B97F4A7C15 * (level * 4 + k + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
    return x


class PerfectHash:
    """Slots 0 to n - 1 for n distinct digests, given as n rows of four 64-bit words.

    A level sets the bits that exactly one digest comes to; the others go on to the next. A digest's slot is the number of set bits
    before its own. Digests that no level parts get the last slots, by their order.
    """

    def __init__(self, words: np.ndarray):
        self.sizes, bits, left = [], [], np.ascontiguousarray(words, np.uint64)
        for level in range(LEVELS):
            if not len(left):
                break
            size = SPREAD * len(left)
            at = (_mixed(left, level) % np.uint64(size)).astype(np.int64)
            single = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            bits.append(single)
            left = left[~single[at]]
        self.rest = left[np.lexsort(left.T[::-1])]
        self._ready(np.concatenate(bits) if bits else np.zeros(0, bool))

    def _ready(self, bits: np.ndarray) -> None:
        self.bits, self.before = bits, np.concatenate([[0], np.cumsum(bits)])

    def __len__(self) -> int:
        return int(self.before[-1]) + len(self.rest)

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each digest. One that was not in the building gets any slot, or -1."""
        out, todo, start = np.full(len(words), -1, np.int64), np.arange(len(words)), 0
        for level, size in enumerate(self.sizes):
            at = start + (_mixed(words[todo], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at]
            out[todo[hit]] = self.before[at[hit]]
            todo, start = todo[~hit], start + size
        if len(self.rest) and len(todo):
            places = {w.tobytes(): k for k, w in enumerate(self.rest)}
            out[todo] = [int(self.before[-1]) + p if (p := places.get(w.tobytes())) is not None else -1 for w in words[todo]]
        return out

    def dump(self) -> tuple[list[int], bytes, bytes]:
        return self.sizes, np.packbits(self.bits).tobytes(), self.rest.tobytes()

    @classmethod
    def load(cls, sizes: list[int], bits: bytes, rest: bytes) -> PerfectHash:
        self = cls.__new__(cls)
        self.sizes, self.rest = [int(s) for s in sizes], np.frombuffer(rest, np.uint64).reshape(-1, 4)
        self._ready(np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(self.sizes)).astype(bool))
        return self


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: Column | None = None) -> DataFrame:
    """Of every row: has (an id), id, at (the row's place, unique), digest of its whole text, old (history holds).

    A null text is empty; ids may be null or repeated. What history leaves null is not of the history. Other columns are left out.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    old = F.coalesce(F.lit(False) if history is None else history, F.lit(False))
    key = F.col(id_col).cast("long")
    return docs.select(key.isNotNull().alias("has"), F.coalesce(key, F.lit(0)).alias("id"), F.monotonically_increasing_id().alias("at"), digest.alias("digest"), old.alias("old"))


def groups(rows: DataFrame) -> DataFrame:
    """digest, n and the winner (has, id, at) of equal texts: the largest id, null last; of equal ids the later place."""
    out = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("has", "id", "at")).alias("w"))
    return out.select("digest", "n", "w.has", "w.id", "w.at")


_INDEX = "shard long, sizes array<long>, bits binary, rest binary, digests binary, has array<boolean>, id array<long>, at array<long>, n array<long>"
_FOUND = "digest binary, n long, has boolean, id long, at long, member boolean"


def _dealt(found: DataFrame, shards: int) -> DataFrame:
    return found.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))


def build(found: DataFrame, shards: int) -> DataFrame:
    """The index of the history's groups: a row for each shard. Digests, locators and counts stand in the order of slots."""

    def one(f: pd.DataFrame) -> pd.DataFrame:
        words = _words(f["digest"])
        table = PerfectHash(words)
        order = np.argsort(table.slots(words))
        sizes, bits, rest = table.dump()
        slots = {c: [f[c].to_numpy()[order]] for c in ("has", "id", "at", "n")}
        return pd.DataFrame({"shard": [f["shard"].iloc[0]], "sizes": [sizes], "bits": [bits], "rest": [rest], "digests": [words[order].tobytes()], **slots})

    return _dealt(found, shards).groupBy("shard").applyInPandas(one, _INDEX)


def lookup(index: DataFrame, found: DataFrame, shards: int) -> DataFrame:
    """What the index and a batch's groups hold together: a row for each distinct text, with digest, n, the winner, member (of the history)."""

    def one(ix: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        names = ["digest", "n", "has", "id", "at"]
        if ix.empty:
            return f[names].assign(member=False)
        row, words = ix.iloc[0], _words(f["digest"])
        held = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
        old = {c: np.array(row[c]) for c in ("has", "id", "at", "n")}
        new = {c: f[c].to_numpy() for c in old}
        slot = PerfectHash.load(row["sizes"], row["bits"], row["rest"]).slots(words)
        member = slot >= 0
        member[member] = (held[slot[member]] == words[member]).all(1)  # all 32 bytes
        at = slot[member]  # a batch tells a digest once, so no slot is changed twice
        mine = {c: new[c][member] for c in new}
        wins = np.zeros(len(at), bool)
        for c in ("at", "id", "has"):  # from the last to the first thing that decides
            wins = (mine[c] > old[c][at]) | (mine[c] == old[c][at]) & wins
        old["n"][at] += mine["n"]
        for c in ("has", "id", "at"):
            old[c][at[wins]] = mine[c][wins]
        kept = pd.DataFrame({"digest": [w.tobytes() for w in held], **old, "member": True})
        return pd.concat([kept, f.loc[~member, names].assign(member=False)])[[*names, "member"]]

    return index.groupBy("shard").cogroup(_dealt(found, shards).groupBy("shard")).applyInPandas(one, _FOUND)


def decided(docs: DataFrame, history: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: id_col, keep_id, group_size, kept, text_sha256 and member (its text occurs in the history).

    history: a condition on docs that tells the rows of which the index is built; the others are the batch that is looked up. Of
    rows of equal text exactly one is kept: that of the largest id, null ids last; of a repeated id the last row. keep_id is null
    where all ids of a group are. Empty tables give no rows; other columns are ignored, whatever their names.
    """
    rows = keep(digests(docs, id_col, text_col, history))
    total = rows.count()
    shards = max(1, -(-total // SHARD))
    index = keep(build(groups(rows.where("old")), shards))
    found = keep(lookup(index, groups(rows.where("NOT old")), shards))
    winners = found.select("digest", F.when(F.col("has"), F.col("id")).alias("keep_id"), F.col("n").alias("group_size"), F.col("at").alias("best"), "member")
    is_hot = F.col("group_size") * HOT > total
    first = rows.join(F.broadcast(winners.where(is_hot)), "digest", "left")  # fewer than HOT rows
    cold = first.where("best IS NULL").select("has", "id", "at", "digest").join(winners.where(~is_hot), "digest")
    names = ["has", "id", "at", "digest", "keep_id", "group_size", "best", "member"]
    out = first.where("best IS NOT NULL").select(*names).unionByName(cold.select(*names))
    own = F.when(F.col("has"), F.col("id")).alias(id_col)
    return out.select(own, "keep_id", "group_size", (F.col("at") == F.col("best")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "member")

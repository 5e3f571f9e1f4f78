"""BPE encoding by a pair occurrence index, and decoding.

The pre-tokens of a batch that are new to the worker are laid out side by side. An index
maps every mergeable pair to all its positions; active ranks are applied in ascending
order, each to all its positions at once, and the lists of the neighbouring pairs follow.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bytebpe import ByteBpe, pieces

#: Bytes, about, of pieces, words and ids that a worker keeps, half of them older ones; which are kept changes no result.
KEPT_BYTES = 96_000_000
#: Characters of text that are encoded together.
BLOCK = 1_000_000
_encoders: dict[str, Encoder] = {}


def merge_all(words: list[bytes], bpe: ByteBpe) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, and where in them each word begins and the last ends; by a pair occurrence index over all of them."""
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths + 1)
    n = int(ends[-1]) if len(words) else 0
    sym = np.full(n, -1, np.int32)  # a place below 0 parts the words
    inside = np.ones(n, bool)
    inside[ends - 1] = False
    sym[inside] = np.array(bpe.of_byte, np.int32)[np.frombuffer(b"".join(words), np.uint8)]
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    keys, rank_of = bpe.sorted_pairs
    merged, pair_of, alone = bpe.merged, bpe.pairs, n < 2

    def known(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) << 32 | right
        i = np.minimum(keys.searchsorted(key), len(keys) - 1)
        hit = ((keys[i] == key) & (left >= 0) & (right >= 0)).nonzero()[0]
        return hit, rank_of[i[hit]]

    index: dict[int, list[int]] = {}
    if not alone:
        at, ranks = known(sym[:-1], sym[1:])
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        index = {int(ranks[c]): part.tolist() for c, part in zip(cuts, np.split(at, cuts[1:]))} if len(cuts) else {}
    active = list(index)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        (a, b), to = pair_of[rank], merged[rank]
        places = np.array(index.pop(rank), np.int64)
        if a == b:  # of overlapping pairs the left one is merged
            places.sort()
            taken, last = [], -1
            for i in places.tolist():
                if i != last and sym[i] == a and sym[j := nxt[i]] == b:
                    taken.append(i)
                    last = j
            i = np.array(taken, np.int64)
        else:
            i = places[sym[places] == a]
            i = i[sym[nxt[i]] == b]
        if not len(i):
            continue
        j = nxt[i]
        sym[i], sym[j] = to, -2
        k, p = nxt[j], prv[i]
        nxt[i], prv[k] = k, i
        first = np.concatenate([i, p[p >= 0]])
        hit, ranks = known(sym[first], sym[nxt[first]])
        for r, at in zip(ranks.tolist(), first[hit].tolist()):
            if (places := index.get(r)) is None:
                index[r] = [at]
                heapq.heappush(active, r)
            else:
                places.append(at)
    left = sym >= 0
    return sym[left].astype("<u4"), np.concatenate([[0], np.cumsum(left)[ends - 1]]) if len(words) else np.zeros(1, np.int64)


class Encoder:
    """Ids as little-endian unsigned 32-bit integers.

    Pieces and the words in them are kept in two halves: a full newer half takes the place of the older one, and what is met again moves to the newer.
    """

    def __init__(self, bpe: ByteBpe):
        self.bpe, self.size = bpe, 0
        self.kept, self.old, self.words, self.old_words = {}, {}, {}, {}
        self.special = {s: np.uint32(i).tobytes() for s, i in bpe.added.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.size >= KEPT_BYTES // 2:
            self.old, self.kept, self.old_words, self.words, self.size = self.kept, {}, self.words, {}, 0
        kept, parted, seen = self.kept, [], set()
        for text in texts:
            parted.append(parts := self.bpe.segments(text))
            for k in range(0, len(parts), 2):
                parts[k] = x = pieces(parts[k])
                x[0] = " " + x[0]  # without an opening space; no other piece begins with one
                seen.update(x)
        new = self._unknown(seen, kept, self.old)
        self._new(new)
        get = kept.__getitem__
        out = [b"".join([self.special[p] if isinstance(p, str) else b"".join(map(get, p)) for p in parts]) for parts in parted]
        self._keep(new, kept)
        return out

    def _unknown(self, seen: set[str], kept: dict[str, bytes], old: dict[str, bytes]) -> list[str]:
        """Those of seen that no half has."""
        out = []
        for x in seen.difference(kept):
            if (ids := old.get(x)) is None:
                out.append(x)
            else:
                kept[x] = ids
                self.size += 220 + len(x) + len(ids)
        return out

    def _keep(self, new: list[str], kept: dict[str, bytes]) -> None:
        for x in new:
            if len(x) > 64:
                del kept[x]
            else:
                self.size += 220 + len(x) + len(kept[x])  # an entry and the heads of two objects

    def _new(self, found: list[str]) -> None:
        split, parted = self.bpe.pre_tokens, []
        for x in found:
            parted.append(split(x[1:] if x[:1] == " " else " " + x))
        new = self._unknown(set(chain.from_iterable(parted)), self.words, self.old_words)
        ids, starts = merge_all([w.encode() for w in new], self.bpe)
        whole, cuts = ids.tobytes(), (starts * 4).tolist()
        self.words.update(zip(new, [whole[s:e] for s, e in zip(cuts, cuts[1:])]))
        get = self.words.__getitem__
        self.kept.update(zip(found, [get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for p in parted]))
        self._keep(new, self.words)

    def decode(self, ids: bytes) -> str:
        tokens = self.bpe.tokens
        return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def blocks(texts: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", check: bool = False) -> DataFrame:
    """docs with three more columns: token_ids (binary, little-endian unsigned 32-bit), n_tokens and decoded (string). With
    check, round_trip (boolean: the ids decode to the text, or to an empty one for null) takes the place of decoded.

    A null text encodes as an empty one. An empty table gives an empty result. Repeated rows
    stay. Columns of docs that have one of the three names are replaced. Texts are taken
    whole; special strings in a text become their special token, nothing is added.
    """
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(ByteBpe.load(tokenizer))
    last, kind = ("round_trip", "boolean") if check else ("decoded", "string")
    docs = docs.drop("token_ids", "n_tokens", last)
    names = docs.columns
    at = names.index(text_col)
    schema = StructType([*docs.schema.fields]).add("token_ids", "binary").add("n_tokens", "long").add(last, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer)
        if encoder is None:
            encoder = _encoders[tokenizer] = Encoder(tables.value)
        for whole in batches:
            done = 0
            texts = [t or "" for t in whole.column(at).to_pylist()]
            for block in blocks(texts):
                batch = whole.slice(done, len(block))
                done += len(block)
                ids = encoder.encode(block)
                told = pa.array([encoder.decode(x) == t for x, t in zip(ids, block)], pa.bool_()) if check else pa.array(map(encoder.decode, ids), pa.string())
                more = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), told]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "token_ids", "n_tokens", last])

    return docs.mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text."""
    return encoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


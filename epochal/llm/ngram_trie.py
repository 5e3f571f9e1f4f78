"""Language-model scores from an Elias-Fano n-gram trie that is spread over shards.

Texts are gathered into blocks of words. Blocks ask shards, shards answer blocks:
1. of its distinct words a block tells their training counts; the word's shard answers
   with the word's number and total count;
2. of its distinct n-grams of the model's order a block tells the training counts. They go to the shard of
   the context's last word, which so knows all contexts that end in it, of every order: it builds
   a trie for each order from all blocks' counts and answers from them.
3. A context word that holds more than a shard's share of all words is heavy. Its n-grams of each order go to the
   shard of their whole context. A context of heavy words alone is parted by its successors; what its parts
   know is added up in a shard of its own, which answers the blocks that hold the context.

A trie has one level for each word: the context from its last word backwards, and then the successor. The
numbers of a level, and the pointers from a level to the ranges of its successors in the next, are monotone sequences
in Elias-Fano form with a select directory; the counts lie beside them in one memory map. A query goes down by searching
the range that belongs to the context, where successors are stored relative to what precedes the range.
Probabilities are discounted relative frequencies (three discounts for each order, from the counts of counts
of all training n-grams), quantised once all shards have told those, and interpolated
with the next lower order, down to the add-0.1 distribution of single words.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Bytes of text in a block, about.
BLOCK_BYTES = 4_000_000
ADDED = 0.1
LEVELS, LEAST_LOG = 4095, -9.0
START, END = 0, 1  # numbers of words begin at 2
_END_KEY = xxhash.xxh64_intdigest(b" end")
#: Kinds of messages: about words, n-grams by the last context word, counts of counts. Of heavy contexts of order k: 4 k and
#: WHOLE, PARTED, or STATS.
WORDS, LIGHT, SEEN = 1, 2, 3
WHOLE, PARTED, STATS = 0, 1, 2
#: In place of a block's number: sums for the driver, and parts of a context for its shard.
_SUMS, _PART = -1, -2


def small(a: np.ndarray) -> np.ndarray:
    """The same numbers, none below 0, in as few bytes each as they need."""
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays as compressed byte planes."""
    head, body = [struct.pack("<I", len(arrays))], []
    for a in arrays:
        head.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)))
        body.append(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())
    raw = b"".join(head + body)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(memoryview(data)[8:], decompressed_size=struct.unpack_from("<Q", data)[0], codec="zstd", asbytes=True)
    n = struct.unpack_from("<I", raw)[0]
    at, out = 4 + n * 10, []
    for k in range(n):
        kind, size = struct.unpack_from("<2sQ", raw, 4 + 10 * k)
        kind = np.dtype(kind.decode())
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += size * kind.itemsize
    return out


def steps(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Rows sorted by the first column, then the second and so on, as what each adds to the row before; whole numbers behind a change further left."""
    out, changed = [], np.zeros(len(columns[0]), bool)
    changed[:1] = True
    for c in columns:
        d = np.diff(c, prepend=0)
        out.append(small(np.where(changed, c, d)))
        changed |= d != 0
    return out


def walked(columns: list[np.ndarray], starts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The columns that steps() took apart, of many messages that begin at starts; and for each where it or one further left changes."""
    out, flags, changed = [], [], np.zeros(len(columns[0]), bool)
    changed[starts] = True
    for d in columns:
        d = d.astype(np.int64)
        at = np.flatnonzero(changed)
        total = np.cumsum(d)
        out.append(total - np.repeat(total[at] - d[at], np.diff(np.append(at, len(d)))))
        changed = changed | (d != 0)
        flags.append(changed)
    return out, flags


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, with the number of ones before each 64 of them."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high.view(np.uint64)
        self.ones = np.zeros(len(self.high) + 1, np.uint32)
        np.cumsum(np.bitwise_count(self.high), out=self.ones[1:])
        self.zeros = (64 * np.arange(len(self.ones)) - self.ones).astype(np.uint32)

    @staticmethod
    def build(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        values = values.astype(np.uint64)
        low = np.zeros(8, np.uint8)
        if bits and n:
            parts = [np.packbits((values[s : s + (1 << 16), None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for s in range(0, n, 1 << 16)]
            low = np.concatenate([*parts, low])
        low = np.concatenate([low, np.zeros(-len(low) % 8, np.uint8)])
        high = np.zeros(((n + (top >> bits)) // 64 + 2) * 8, np.uint8)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        np.bitwise_or.at(high, places >> 3, (1 << (places & 7)).astype(np.uint8))
        return n, bits, low, high

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        first, out = at >> 3, np.zeros(len(i), np.uint64)
        for b in range((self.low_bits + 14) // 8):
            out |= self.low[first + b].astype(np.uint64) << np.uint64(8 * b)
        return ((out >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def _select(self, i: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Places of the i-th ones or, with flip, zeros of the high bits."""
        at = np.searchsorted(before, i.astype(np.uint32), "right") - 1
        word = ~self.high[at] if flip else self.high[at]
        rest = (i - before[at]).astype(np.uint8)
        place = at.astype(np.int64) << 6
        for half in (32, 16, 8, 4, 2, 1):
            lower = np.bitwise_count(word & np.uint64((1 << half) - 1))
            up = rest >= lower
            rest -= np.where(up, lower, 0).astype(np.uint8)
            word = word >> np.where(up, half, 0).astype(np.uint64)
            place += np.where(up, half, 0)
        return place

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self._select(i, self.ones, False) - i << self.low_bits) | self._low(i)

    def find(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of x in the ranges from start to end, -1 where x isn't there."""
        h = x >> self.low_bits
        ok = (x >= 0) & (h < int(self.zeros[-1]))
        g = np.where(ok, h, 0)
        low = np.maximum(start, np.where(g > 0, self._select(np.maximum(g - 1, 0), self.zeros, True) - (g - 1), 0))
        high = np.where(ok, np.minimum(end, self._select(g, self.zeros, True) - g), low)
        want = x & ((1 << self.low_bits) - 1)
        last = high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            less = self._low(mid) < want[open_]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
            open_ = open_[low[open_] < high[open_]]
        inside = np.flatnonzero(low < last)
        out = np.full(len(x), -1)
        hit = inside[self._low(low[inside]) == want[inside]]
        out[hit] = low[hit]
        return out


def quantise(p: np.ndarray) -> np.ndarray:
    """1 to LEVELS by the logarithm; 0 for 0."""
    with np.errstate(divide="ignore"):
        log = np.log10(p)
    return np.where(p > 0, 1 + np.rint(np.clip(1 - log / LEAST_LOG, 0, 1) * (LEVELS - 1)), 0).astype(np.uint16)


VALUES = np.concatenate([[0.0], 10.0 ** (LEAST_LOG * (1 - np.arange(LEVELS) / (LEVELS - 1)))])


def counts_of_counts(counts: np.ndarray) -> np.ndarray:
    """How many of counts are 1, 2 and so on to 5."""
    return np.bincount(np.minimum(counts, 6), minlength=7)[1:6].astype(np.int64)


def discounts(seen: np.ndarray) -> np.ndarray:
    """What is taken off counts of 1, 2, and 3 or more, at places 1 to 3; seen: counts_of_counts of all n-grams of an order."""
    n = np.concatenate([[0], seen]).astype(float)
    out = np.array([0, 0.75, 1.0, 1.25])
    if n[1] and n[2]:
        y = n[1] / (n[1] + 2 * n[2])
        for k in (1, 2, 3):
            if n[k] and n[k + 1]:
                out[k] = min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05 * k), 0.98 * k)
    return out


class Trie:
    """Levels: columns of distinct n-grams, sorted by the first, then the second and so on; count: of each, above 0."""

    def __init__(self, buffer):
        """Opens what to_map() made; the arrays are views of the buffer."""
        self.buffer, at = buffer, 0
        (order,) = struct.unpack_from("<Q", buffer, at)
        sizes = struct.unpack_from(f"<{8 * order}Q", buffer, 8)
        at = 8 + 64 * order
        self.levels, self.pointers = [], []

        def sequence(n, bits, low, high):
            nonlocal at
            out = EliasFano(n, bits, np.frombuffer(buffer, np.uint8, low, at), np.frombuffer(buffer, np.uint8, high, at + low))
            at += low + high
            return out

        for k in range(order):
            self.levels.append(sequence(*sizes[8 * k : 8 * k + 4]))
            self.pointers.append(sequence(*sizes[8 * k + 4 : 8 * k + 8]) if k + 1 < order else None)
        contexts, leaves = self.levels[-2].n, self.levels[-1].n
        self.total = np.frombuffer(buffer, np.uint32, contexts, at)
        # successors seen once, twice, and more often
        self.kinds = np.frombuffer(buffer, np.uint32, 3 * contexts, at + 4 * contexts).reshape(3, contexts)
        self.count = np.frombuffer(buffer, np.uint32, leaves, at + 16 * contexts)

    @staticmethod
    def to_map(columns: list[np.ndarray], count: np.ndarray) -> mmap.mmap:
        order, n = len(columns), len(count)
        new = np.zeros(n, bool)
        new[:1] = True
        parts, sizes, parent = [], [], np.zeros(n, np.int64)
        for k, c in enumerate(columns):
            above = new.copy()
            if n:
                new[1:] |= c[1:] != c[:-1]
            at = np.flatnonzero(new)
            values = c[at].astype(np.int64)
            if k:  # relative to the last of the range before: monotone over all ranges
                first = np.flatnonzero(above[at])
                last = values[np.append(first[1:], len(at)) - 1]
                base = np.concatenate([[0], np.cumsum(last + 1)[:-1]]) if len(first) else np.zeros(0, np.int64)
                values = values + np.repeat(base, np.diff(np.append(first, len(at))))
                pointers = EliasFano.build(np.append(first, len(at)).astype(np.int64))
                sizes += [pointers[0], pointers[1], len(pointers[2]), len(pointers[3])]
                parts += pointers[2:]
            level = EliasFano.build(values)
            sizes += [level[0], level[1], len(level[2]), len(level[3])]
            parts += level[2:]
            if k == order - 2:
                parent = np.cumsum(new) - 1
        contexts = int(parent[-1]) + 1 if n else 0
        kinds = [np.bincount(parent, np.minimum(count, 3) == k, contexts) for k in (1, 2, 3)]
        tail = [x.astype(np.uint32) for x in (np.bincount(parent, count, contexts), *kinds, count)]
        # sizes of a level and then of the pointers from it
        heads = sizes + [0] * (8 * order - len(sizes))
        raw = [struct.pack("<Q", order), struct.pack(f"<{8 * order}Q", *heads), *(p.tobytes() for p in parts), *(t.tobytes() for t in tail)]
        out = mmap.mmap(-1, max(1, sum(map(len, raw))))
        for r in raw:
            out.write(r)
        return out

    def find(self, nodes: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """nodes: for each level the place of each asked node's parent among those asked of the level above, and its word.
        Places in the trie of the contexts (the level before the last) and of the n-grams, -1 where there is none."""
        value = nodes[0][1]
        at = self.levels[0].find(value.astype(np.int64), np.zeros(len(value), np.int64), np.full(len(value), self.levels[0].n))
        context = at
        for k, (parent, value) in enumerate(nodes[1:], 1):
            context = at
            known = np.maximum(context, 0)
            start, end = self.pointers[k - 1].get(known), self.pointers[k - 1].get(known + 1)
            before = np.where(start > 0, self.levels[k].get(np.maximum(start - 1, 0)) + 1, 0)
            at = np.full(len(value), -1)
            ask = np.flatnonzero(context[parent] >= 0)
            of = parent[ask]
            at[ask] = self.levels[k].find(value[ask].astype(np.int64) + before[of], start[of], end[of])
        return context, at


def _mix(*columns: np.ndarray) -> np.ndarray:
    """A 64-bit hash of integer columns."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def _deal(shards: int, *columns: np.ndarray) -> np.ndarray:
    return (_mix(*columns) % np.uint64(shards)).astype(np.int64)


def _groups(sorted_keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    cuts = np.flatnonzero(np.diff(sorted_keys, prepend=-2)) if len(rows) else []
    for s, e in zip(cuts, [*cuts[1:], len(rows)]):
        yield int(sorted_keys[s]), rows[s:e]


def distinct(a: np.ndarray) -> np.ndarray:
    a = np.sort(a)
    return a[np.diff(a, prepend=a[:1] - 1) != 0]


class Block:
    """Tokens of texts as local word numbers, frequent words first; home: the shard of each word."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, train: np.ndarray, home: np.ndarray):
        self.tokens, self.lengths, self.train, self.home = tokens, lengths, train, home

    @classmethod
    def of(cls, texts: list[str], train: list[bool], shards: int) -> tuple[Block, bytes]:
        """And what it asks about its words: their keys and training counts."""
        words, lengths = [], []
        for t in texts:
            w = t.encode("utf-8", "surrogatepass").lower().split()
            words += w
            words.append(b" ")
            lengths.append(len(w) + 1)
        known = {w: k for k, w in enumerate(dict.fromkeys(words))}
        tokens = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        keys = np.fromiter((_END_KEY if w == b" " else xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
        order = np.lexsort((keys, -np.bincount(tokens)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        tokens, keys = place[tokens], keys[order]
        out = cls(tokens, np.array(lengths, np.int64), np.array(train, bool), (keys % np.uint64(shards)).astype(np.int64))
        return out, pack([np.diff(keys, prepend=np.uint64(0)), small(np.bincount(tokens, out.trained(), len(keys)).astype(np.int64))])

    def pack(self) -> bytes:
        return pack([small(self.tokens), small(self.lengths), self.train.astype(np.uint8), small(self.home)])

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        tokens, lengths, train, home = unpack(data)
        return cls(tokens.astype(np.int64), lengths.astype(np.int64), train.astype(bool), home.astype(np.int64))

    def trained(self) -> np.ndarray:
        return np.repeat(self.train, self.lengths)

    def take_words(self, answers: dict[int, bytes]) -> None:
        """number and count of each local word, and whether no other block holds it, held-out texts included (or no training text)."""
        self.number, self.count = np.zeros(len(self.home), np.int64), np.zeros(len(self.home), np.int64)
        self.own = np.zeros(len(self.home), bool)
        order = np.argsort(self.home, kind="stable")
        for s, rows in _groups(self.home[order], order):
            number, count, alone = unpack(answers[s])
            self.number[rows], self.count[rows], self.own[rows] = number, count, alone > 0
        self.own |= self.count == 0


def word_asks(words: bytes, shards: int) -> Iterator[tuple[int, bytes]]:
    gaps, count = unpack(words)
    keys = np.cumsum(gaps, dtype=np.uint64)
    home = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    for s, rows in _groups(home[order], order):
        yield s, pack([np.diff(keys[rows], prepend=np.uint64(0)), count[rows]])


class Order:
    """The distinct n-grams of one order in a block, sorted by home and then by the context, nearest word first, and the last word."""

    def __init__(self, columns: list[np.ndarray], context: np.ndarray, home: np.ndarray, count: np.ndarray, where: np.ndarray, valid: np.ndarray):
        self.columns, self.home, self.count, self.where, self.valid = columns, home, count, where, valid
        self.opens = np.flatnonzero(np.diff(context, prepend=-1))
        self.context_of = np.repeat(np.arange(len(self.opens)), np.diff(np.append(self.opens, len(context))))


class Grams:
    """The distinct n-grams of a block of orders 2 and above, and where they go.

    A context whose last word only this block holds is seen nowhere else: it isn't asked about, but answered from tries
    of the block itself, shard OWN. Places before a text's beginning hold START; n-grams of an order above 2 with
    more than one carry lower orders to their shard, but don't count themselves (valid).
    """

    OWN = -1

    def __init__(self, block: Block, order: int, shards: int, total: int):
        n, words = len(block.tokens), len(block.home) + 1  # one more for the start
        place = np.arange(n) - np.repeat(np.cumsum(block.lengths) - block.lengths, block.lengths)
        back = [block.tokens + 1]  # 0 is the start
        for k in range(1, order):
            prior = np.zeros(n, np.int64)
            prior[k:] = block.tokens[: n - k] + 1
            prior[place < k] = 0
            back.append(prior)
        number = np.concatenate([[START], block.number])
        held = np.concatenate([block.count[block.number == END][:1], block.count])  # a start for each end
        own = np.concatenate([[False], block.own])
        self.held, self.shards, self.total, self.order = held, shards, total, order
        self.heavy = ~own & (held * shards > total)
        home = np.where(own, self.OWN, np.where(self.heavy, shards, _deal(shards, number)))
        by_home, by_number = np.lexsort((number, home)), np.argsort(number)
        first, rank = np.empty(words, np.int64), np.empty(words, np.int64)
        first[by_home], rank[by_number] = np.arange(words), np.arange(words)
        trained, context, self.orders = block.trained(), first[back[1]], {}
        for k in range(2, order + 1):
            if k > 2:
                context = np.unique(context * words + rank[back[k - 1]], return_inverse=True)[1]
            found, where = np.unique(context * words + rank[back[0]], return_inverse=True)
            at = np.empty(len(found), np.int64)
            at[where] = np.arange(n)  # one of its tokens
            local = [back[j][at] for j in range(1, k)]
            count = np.bincount(where, trained, len(found)).astype(np.int64)
            valid = local[-2] != 0 if k > 2 else np.ones(len(found), bool)
            self.orders[k] = Order([*(number[c] for c in local), number[back[0][at]]], found // words, home[local[0]], count, where, valid)
            # the parts of heavy contexts
            of = self.orders[k]
            of.heavy = np.flatnonzero((of.home == shards) & valid)
            least = np.min([held[c[of.opens]] for c in local], axis=0)
            of.pieces = np.maximum(1, -(-least * shards // max(1, total)))

    def asks(self, own: bool = False) -> Iterator[tuple[int, int, bytes]]:
        """(kind, shard, message): to the shards or, with own, the one that the block itself answers."""
        top = self.orders[self.order]
        for s, rows in _groups(top.home, np.arange(len(top.home))):
            if s == self.OWN if own else 0 <= s < self.shards:
                yield LIGHT, s, pack([*steps([c[rows] for c in top.columns]), small(top.count[rows])])
        if own:
            return
        for k, of in self.orders.items():
            for kind in (WHOLE, PARTED):
                for s, rows in self._dealt(k, kind):
                    yield 4 * k + kind, s, pack([*steps([c[rows] for c in of.columns]), small(of.count[rows])])
            for s, rows in self._parted(k):
                yield 4 * k + STATS, s, pack(steps([c[of.opens[rows]] for c in of.columns[:-1]]))

    def _dealt(self, k: int, kind: int) -> Iterator[tuple[int, np.ndarray]]:
        """n-grams of heavy contexts of order k by shards."""
        of = self.orders[k]
        pieces = of.pieces[of.context_of[of.heavy]]
        rows = of.heavy[(pieces > 1) == (kind == PARTED)]
        columns = [c[rows] for c in of.columns]
        part = (_mix(columns[-1]) % of.pieces[of.context_of[rows]].astype(np.uint64)).astype(np.int64)
        shard = _deal(self.shards, *columns[:-1], part, np.full(len(rows), k))
        order = np.argsort(shard, kind="stable")
        return _groups(shard[order], rows[order])

    def _parted(self, k: int) -> Iterator[tuple[int, np.ndarray]]:
        """Contexts of order k that are parted, by the shards that add them up."""
        of = self.orders[k]
        rows = np.unique(of.context_of[of.heavy])
        rows = rows[of.pieces[rows] > 1]
        shard = _deal(self.shards, *(c[of.opens[rows]] for c in of.columns[:-1]))
        order = np.argsort(shard, kind="stable")
        return _groups(shard[order], rows[order])

    def own_counts(self) -> np.ndarray:
        """counts_of_counts, order by order, of the n-grams that the block itself answers."""
        of = self.orders.values()
        return np.concatenate([counts_of_counts(o.count[(o.home == self.OWN) & o.valid & (o.count > 0)]) for o in of])

    def take(self, answers: dict[tuple[int, int], bytes], off: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order and token the discounted share, and the share left to the lower order (1 if the context is unknown). off: discounts()."""
        got = {k: (np.zeros((4, len(o.opens)), np.int64), np.zeros(len(o.home), np.int64)) for k, o in self.orders.items()}
        top = self.orders[self.order]
        for s, _ in _groups(top.home, np.arange(len(top.home))):
            if s >= self.shards:
                continue
            arrays = unpack(answers[LIGHT, s])
            for j, (k, of) in enumerate(self.orders.items()):
                stats, count = got[k]
                low, high = np.searchsorted(of.home, [s, s + 1])
                at = slice(*np.searchsorted(of.opens, [low, high]))
                stats[:, at], count[low:high] = _stats(arrays[5 * j : 5 * j + 4]), arrays[5 * j + 4]
        for k, of in self.orders.items():
            stats, count = got[k]
            for kind in (WHOLE, PARTED):
                for s, rows in self._dealt(k, kind):
                    *told, c = unpack(answers[4 * k + kind, s])
                    count[rows] = c
                    if kind == WHOLE:
                        at = of.context_of[rows]
                        stats[:, at[np.diff(at, prepend=-1) != 0]] = _stats(told)
            for s, rows in self._parted(k):
                stats[:, rows] = _stats(unpack(answers[4 * k + STATS, s]))
            whole = np.maximum(stats[0], 1)
            left = VALUES[quantise(off[k][1:] @ stats[1:] / whole)][of.context_of]
            share = VALUES[quantise((count - off[k][np.minimum(count, 3)]) / whole[of.context_of])]
            known = (stats[0] > 0)[of.context_of] & of.valid
            yield np.where(known, share, 0.0)[of.where], np.where(known, left, 1.0)[of.where]


def _residual(stats: np.ndarray) -> np.ndarray:
    """Rows total, seen once, twice and more: of the total what these don't say."""
    return np.stack([stats[0] - stats[1] - 2 * stats[2] - 3 * stats[3], *stats[1:]])


def _stats(told: list[np.ndarray]) -> np.ndarray:
    stats = np.stack([x.astype(np.int64) for x in told])
    stats[0] += stats[1] + 2 * stats[2] + 3 * stats[3]
    return stats


def _answer_words(frame: pd.DataFrame, shards: int) -> pd.DataFrame:
    shard = int(frame["shard"].iloc[0])
    asked = [unpack(d) for d in frame["data"]]
    keys = [np.cumsum(a[0], dtype=np.uint64) for a in asked]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(inverse, np.concatenate([a[1] for a in asked]), len(distinct)).astype(np.int64)
    alone = (np.bincount(inverse, minlength=len(distinct)) == 1).astype(np.uint8)  # a block asks once
    rank = np.empty(len(distinct), np.int64)
    rank[np.lexsort((distinct, -count))] = np.arange(len(distinct))
    number = rank * shards + shard + 2
    number[distinct == np.uint64(_END_KEY)] = END
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    data = [pack([small(number[i]), small(count[i]), alone[i]]) for i in np.split(inverse, cuts)]
    return pd.DataFrame({"block": [*frame["block"], _SUMS], "shard": shard, "kind": WORDS, "data": [*data, b""], "seen": [None] * len(data) + [[int((count > 0).sum())]]})


def _answer_grams(frame: pd.DataFrame, order: int, shards: int) -> pd.DataFrame:
    """Answers to the blocks, and for block _SUMS the counts_of_counts. What is asked of parted contexts goes on as it is, beside the parts."""
    kind, shard = int(frame["kind"].iloc[0]), int(frame["shard"].iloc[0])
    if kind == SEEN:
        seen = np.sum([unpack(d)[0].astype(np.int64) for d in frame["data"]], axis=0)
        return pd.DataFrame({"block": [_SUMS], "shard": shard, "kind": kind, "data": [b""], "seen": [seen.tolist()]})
    if kind > SEEN and kind % 4 == STATS:
        return frame.assign(seen=None)
    orders = list(range(2, order + 1)) if kind == LIGHT else [kind // 4]
    data, seen, parts = _answers([unpack(d) for d in frame["data"]], orders, parted=kind != LIGHT and kind % 4 == PARTED)
    told = np.zeros((order - 1, 5), np.int64)
    told[np.array(orders) - 2] = seen
    block, to, kinds = [*frame["block"], _SUMS], [shard] * (len(data) + 1), [kind] * (len(data) + 1)
    out = [*data, b""]
    if parts:
        of, stats = parts
        to_shard = _deal(shards, *of)
        sort = np.argsort(to_shard, kind="stable")
        for s, rows in _groups(to_shard[sort], sort):
            block.append(_PART)
            to.append(s)
            kinds.append(kind - PARTED + STATS)
            out.append(pack([*steps([c[rows] for c in of]), *(small(x[rows]) for x in stats)]))
    return pd.DataFrame({"block": block, "shard": to, "kind": kinds, "data": out, "seen": [None] * len(data) + [told.ravel().tolist()] + [None] * (len(out) - len(data) - 1)})


def _answers(asked: list[list[np.ndarray]], orders: list[int], parted: bool = False):
    """Answers to messages of n-grams of the highest of orders, about each order; counts_of_counts of each; with parted, contexts and what is known of them."""
    starts = np.cumsum([0, *(len(a[0]) for a in asked)])[:-1]
    told = [np.concatenate([a[k] for a in asked]) for k in range(len(asked[0]))]
    columns, changes = walked(told[:-1], starts)
    count, top = told[-1].astype(np.int64), len(columns)
    universe, ranks = np.unique(np.concatenate(columns), return_inverse=True)
    ranks, words = ranks.reshape(top, -1), len(universe)
    # contexts of each length, by their nearest word first
    node, nodes = np.zeros(len(count), np.int64), []
    for k in range(top - 1):
        found, node = np.unique(node * words + ranks[k], return_inverse=True)
        nodes.append((found // words, universe[found % words], node))
    out, seen, parts = [[] for _ in asked], [], None
    for k in orders:
        of = nodes[k - 2][2]
        found, gram = np.unique(of * words + ranks[-1], return_inverse=True)
        parent, last = found // words, universe[found % words]
        summed = np.bincount(gram, count, len(found)).astype(np.int64)
        chain, at = [], parent
        for up, value, _ in reversed(nodes[: k - 1]):
            chain.insert(0, value[at])
            at = up[at]
        learned = np.flatnonzero((summed > 0) & (chain[k - 3] != START if k > 2 else True))
        stats, number = np.zeros((4, len(nodes[k - 2][0])), np.int64), np.zeros(len(found), np.int64)
        if len(learned):
            trie = Trie(Trie.to_map([*(c[learned] for c in chain), last[learned]], summed[learned]))
            context, leaf = trie.find([*((p, v) for p, v, _ in nodes[: k - 1]), (parent, last)])
            known = context >= 0
            stats[0, known], stats[1:, known] = trie.total[context[known]], trie.kinds[:, context[known]]
            number[leaf >= 0] = trie.count[leaf[leaf >= 0]]
        seen.append(counts_of_counts(summed[learned]))
        message = np.repeat(np.arange(len(asked)), np.diff(np.append(starts, len(count))))
        pick = np.flatnonzero(changes[k - 2])
        for r in _residual(stats):
            for m, x in enumerate(np.split(r[of[pick]], np.searchsorted(pick, starts[1:]))):
                out[m].append(small(x))
        if k < top:  # some n-grams of the message are one of this order
            each = distinct(message * len(found) + gram)
            gram, bounds = each % len(found), np.searchsorted(each // len(found), np.arange(1, len(asked)))
        else:
            bounds = starts[1:]
        for m, x in enumerate(np.split(number[gram], bounds)):
            out[m].append(small(x))
        if parted:
            up, value, _ = nodes[k - 2]
            of, at = [value], up
            for more, value, _ in reversed(nodes[: k - 2]):
                of.insert(0, value[at])
                at = more[at]
            parts = of, stats
    return [pack(a) for a in out], seen, parts


def _add_up(frame: pd.DataFrame) -> pd.DataFrame:
    """Answers about parted contexts: the sums of their parts."""
    told = [(b, unpack(d)) for b, d in zip(frame["block"], frame["data"])]
    width = min(len(a) for _, a in told) if any(b >= 0 for b, _ in told) else len(told[0][1]) - 4
    starts = np.cumsum([0, *(len(a[0]) for _, a in told)])
    columns, _ = walked([np.concatenate([a[k] for _, a in told]) for k in range(width)], starts[:-1])
    stats = [np.concatenate([a[width + r].astype(np.int64) if b == _PART else np.zeros(len(a[0]), np.int64) for b, a in told]) for r in range(4)]
    node = np.zeros(starts[-1], np.int64)
    for c in columns:
        rank = np.unique(c, return_inverse=True)[1]
        node = np.unique(node * (int(rank.max(initial=0)) + 1) + rank, return_inverse=True)[1]
    sums = np.stack([np.bincount(node, r).astype(np.int64) for r in stats])
    asks = [(b, slice(s, e)) for (b, _), s, e in zip(told, starts, starts[1:]) if b >= 0]
    return pd.DataFrame({"block": [b for b, _ in asks], "shard": int(frame["shard"].iloc[0]), "kind": int(frame["kind"].iloc[0]), "data": [pack([small(r) for r in _residual(sums[:, node[at]])]) for _, at in asks]})


def score(docs: DataFrame, order: int = 3) -> DataFrame:
    """docs: doc_id, text, held_out. One row for each: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score (log10 probabilities of the whole text, its end included).

    Learns from the rows that aren't held out. A null text counts as empty: one token, the end.
    Repeated rows count and are scored each. Without training rows every word has the base
    probability of an unknown one. Other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    shards = max(1, -(-size // BLOCK_BYTES))
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    limit = BLOCK_BYTES

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, ids, texts, held, n, kind = 0, [], [], [], 0, None

        def flush():
            block, words = Block.of(texts, [not h for h in held], shards)
            number = (TaskContext.get().partitionId() << 24) | made
            arrays = [pa.array([number], pa.int64()), pa.array([block.pack()], pa.binary()), pa.array([words], pa.binary()), pa.array([ids], pa.list_(kind)), pa.array([held], pa.list_(pa.bool_())), pa.array([int(block.trained().sum())], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["block", "data", "words", "ids", "held", "trained"])

        for b in batches:
            kind = b.column(0).type
            for i, t, h in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                t = t.as_py() or ""
                ids.append(i)
                texts.append(t)
                held.append(h)
                n += len(t) + 16
                if n >= limit:
                    yield flush()
                    made, ids, texts, held, n = made + 1, [], [], [], 0
        if texts:
            yield flush()

    blocks = keep(docs.mapInArrow(gather, f"block long, data binary, words binary, ids array<{kind_of_id}>, held array<boolean>, trained long"))
    total = blocks.agg(F.sum("trained")).first()[0] or 0

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, words in zip(b.column(0).to_pylist(), b.column(1)):
                asks = list(word_asks(words.as_py(), shards))
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(asks), pa.int64()), pa.array([s for s, _ in asks], pa.int64()), pa.array([d for _, d in asks], pa.binary())], names=["block", "shard", "data"])

    message = "block long, shard long, kind int, data binary"
    words = blocks.select("block", "words").mapInArrow(ask_words, "block long, shard long, data binary")
    words = keep(words.groupBy("shard").applyInPandas(lambda f: _answer_words(f, shards), f"{message}, seen array<long>"))
    vocabulary = words.where(F.col("block") == _SUMS).agg(F.sum(F.col("seen")[0])).first()[0] or 0
    words = words.where("block >= 0").select("block", "shard", "kind", "data")

    def ask(state: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, data in zip(state["block"], state["data"]):
            block = Block.unpack(data)
            block.take_words(dict(zip(answers["shard"], answers["data"])))
            grams = Grams(block, order, shards, total)
            out += [(number, s, kind, d) for kind, s, d in grams.asks()]
            out.append((number, number % shards, SEEN, pack([grams.own_counts()])))
        return pd.DataFrame(out, columns=["block", "shard", "kind", "data"])

    asked = blocks.select("block", "data").groupBy("block").cogroup(words.groupBy("block")).applyInPandas(ask, message)
    told = keep(asked.groupBy("shard", "kind").applyInPandas(lambda f: _answer_grams(f, order, shards), f"{message}, seen array<long>"))
    sums = told.where(F.col("block") == _SUMS).agg(*[F.sum(F.col("seen")[k]) for k in range(5 * (order - 1))]).first()
    off = {k: discounts(np.array([x or 0 for x in sums[5 * (k - 2) : 5 * (k - 1)]])) for k in range(2, order + 1)}
    told = told.select("block", "shard", "kind", "data")
    stats = (F.col("kind") > SEEN) & (F.col("kind") % 4 == STATS)
    added = told.where(stats).groupBy("shard", "kind").applyInPandas(_add_up, message)

    def finish(state: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        frames = []
        for data, ids, held in zip(state["data"], state["ids"], state["held"]):
            block = Block.unpack(data)
            of = dict(zip(zip(answers["kind"], answers["shard"]), answers["data"]))
            block.take_words({s: d for (k, s), d in of.items() if k == WORDS})
            p = ((block.count + ADDED) / (total + ADDED * (vocabulary + 1)))[block.tokens]
            first = np.cumsum(block.lengths) - block.lengths
            per = lambda x: np.add.reduceat(x, first)  # noqa: E731, B023
            base_score, known = per(np.log10(p)), per((block.count > 0)[block.tokens].astype(np.int64))
            grams = Grams(block, order, shards, total)
            for kind, s, d in grams.asks(own=True):
                of[kind, s] = _answers([unpack(d)], list(range(2, order + 1)))[0][0]
            for share, left in grams.take(of, off):
                p = share + left * p
            frames.append(pd.DataFrame({"doc_id": ids, "held_out": held, "n_tokens": block.lengths, "n_known": known, "train_tokens": total, "base_score": base_score, "score": per(np.log10(p))}))
        return pd.concat(frames)

    answers = words.union(told.where((F.col("block") >= 0) & ~stats)).union(added)
    shape = f"doc_id {kind_of_id}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.select("block", "data", "ids", "held").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, shape)

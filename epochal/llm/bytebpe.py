"""Byte-level BPE vocabularies and how texts fall into the pieces that are merged separately.

A text is first parted at added special strings, then at every single space before a
visible character (such a space always opens a piece), then by the vocabulary's
pre-token pattern. Pieces recur, so callers keep what they found for each piece.
"""

from __future__ import annotations

import heapq
import json
import re
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import regex

#: Pre-token pattern of the byte-level vocabularies; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t-\r \x85\xa0  -     　"
OPENING = re.compile(f" (?=[^{SPACE}])")
_UNOPENING = re.compile(f" [{SPACE}]")


def pieces(segment: str) -> list[str]:
    """The piece before the first opening space, which may be empty, then those after each, without it."""
    if segment[-1:] == " " or _UNOPENING.search(segment):
        return OPENING.split(segment)
    return segment.split(" ")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class ByteBpe:
    """tokens: bytes by id; ranks: (left id << 32 | right id) to rank; merged: id by rank; added: special strings to ids."""

    tokens: dict[int, bytes]
    ranks: dict[int, int]
    merged: list[int]
    added: dict[str, int]
    path: str
    odd: set[str] = field(default_factory=set)
    seen: set[str] = field(default_factory=set)

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        letters = byte_letters()
        added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        vocab = whole["model"]["vocab"]
        tokens = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if s not in added}
        tokens |= {i: s.encode() for s, i in added.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in whole["model"]["merges"]]
        ranks = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in reversed([*enumerate(pairs)])}
        return cls(tokens, ranks, [vocab[a + b] for a, b in pairs], added, path)

    @cached_property
    def of_byte(self) -> list[int]:
        single = {t[0]: i for i, t in self.tokens.items() if len(t) == 1 and i not in self.added.values()}
        return [single[b] for b in range(256)]

    @cached_property
    def sorted_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.fromiter(self.ranks, np.int64, len(self.ranks))
        order = np.argsort(keys)
        return keys[order], np.fromiter(self.ranks.values(), np.int64, len(keys))[order]

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """Left and right id by rank."""
        return {r: (k >> 32, k & 0xFFFFFFFF) for k, r in self.ranks.items()}

    @cached_property
    def _special(self) -> re.Pattern | None:
        return re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    @cached_property
    def _pattern(self):
        return regex.compile(PATTERN)

    @cached_property
    def _library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).pre_tokenizer

    def segments(self, text: str) -> list[str]:
        """Ordinary text at even places, special strings at odd ones."""
        if self._special is None or not any(s in text for s in self.added):
            return [text]
        return self._special.split(text)

    def pre_tokens(self, piece: str) -> list[str]:
        """Unicode tables of libraries differ by version: a piece with a character that the
        tokenizer's own splitter classes otherwise than the regex module is split by the former."""
        if piece.isascii():
            word, end = piece.rstrip(".,"), len(piece)
            if (word[1:] if word[:1] == " " else word).isalpha():
                return [word, piece[len(word) :]] if len(word) < end else [word]
        else:
            for c in set(piece) - self.seen:
                self.seen.add(c)
                probe = f"a{c}1{c} ;{c}"
                if self._pattern.findall(probe) != self._by_library(probe):
                    self.odd.add(c)
            if self.odd and not self.odd.isdisjoint(piece):
                return self._by_library(piece)
        return self._pattern.findall(piece)

    def _by_library(self, piece: str) -> list[str]:
        return [piece[i:j] for _, (i, j) in self._library.pre_tokenize_str(piece)]

    @cached_property
    def _of_bytes(self) -> list[int]:
        """Rank of a pair of bytes, at left << 8 | right."""
        one, get, none = self.of_byte, self.ranks.get, len(self.merged)
        return [get(one[k >> 8] << 32 | one[k & 255], none) for k in range(65536)]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank is merged first, the leftmost of equals."""
        if len(word) > 64:
            return self._merge_long([self.of_byte[b] for b in word])
        one, two, get, none, merged = self.of_byte, self._of_bytes, self.ranks.get, len(self.merged), self.merged
        ids = [one[b] for b in word]
        pairs = [two[a << 8 | b] for a, b in zip(word, word[1:])]
        while pairs:
            rank = min(pairs)
            if rank == none:
                break
            i = pairs.index(rank)
            ids[i] = to = merged[rank]
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] << 32 | to, none)
            if i < len(pairs):
                pairs[i] = get(to << 32 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, ranks, merged = len(ids), self.ranks, self.merged
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merged[r], -1
            nxt[i] = k = nxt[j]
            if k >= 0:
                prv[k] = i
            for p, q in ((i, k), (prv[i], i)):
                if p >= 0 and q >= 0 and (r := ranks.get(ids[p] << 32 | ids[q])) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

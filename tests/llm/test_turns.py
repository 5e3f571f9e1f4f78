"""Prefix tries, exact duplicates and repaired turns against brute force over plain Python objects."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.llm import exact_dedup, prefix_trie, queries, turn_repair

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def talks():
    rng = random.Random(5)
    rows = []
    for c in range(70):
        for t in range(rng.choice([0, 1, 1, 2, 3, 4, 7])):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "tool", ""]), rng.choice(["Yes.", "no", "", " ", None, "What? ", "long text of some words!\n"])))
    rows += [(200 + k, t, ["user", "assistant"][t % 2], "same.") for k in range(9) for t in range(6)]  # copies
    rows += [(-7, 0, "user", "below zero."), (300, None, "user", "no turn."), (300, None, "assistant", "none either"), (300, 4, "user", "later.")]
    rows += [(301, 1, "user", "tie b."), (301, 1, "user", "tie a."), (301, 1, "user", "tie b."), (None, 0, "user", "no id.")]
    rows += [(302, t, "user" if t % 2 else "system", "ÄÖ ü. " * 40) for t in range(40)]
    return rows


@pytest.fixture(scope="module")
def conversations(spark):
    d = spark.createDataFrame(talks(), "conv_id long, turn long, role string, text string")
    names = ["pos", "digest", "tokens", "len", "node", "parent", "fault", "at", "kind", "rows", "cost", "audit"]
    return d.withColumns({n: F.lit("?") for n in names}).repartition(3)


@pytest.fixture(scope="module")
def folder(conversations, tmp_path_factory):
    at = tmp_path_factory.mktemp("turns")
    conversations.write.parquet(f"file://{at}/conversations.parquet")
    return f"file://{at}"


def order(rows):
    """Of one conversation, as the trie orders them."""
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", bytes.fromhex(sha(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}")))
    return [(r[2] or "", r[3] or "") for r in sorted(rows, key=key)]


def by_conv(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_trie(spark, folder):
    own = {c: order(r) for c, r in by_conv(talks()).items() if c is not None}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(donor, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    want = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        kids = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * len(WORD.findall(p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(prefix))
        parent = min(nodes[prefix[:-1]]) if prefix else None
        want.append((min(members), len(prefix), parent, len(members), len(kids), len(leaves), saved, sha(ends)))
    got = queries.op11_prefix_trie(spark, folder)
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(want, key=str)


def test_trie_of_nothing(spark, conversations):
    nodes, ends = prefix_trie.trie(*prefix_trie.spliced(prefix_trie.coded(conversations.limit(0))))
    assert nodes.count() == 0 and ends.count() == 0


def test_long_conversations_and_lists(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)
    rows = [(c, t, "user", f"{c % 2} {t}") for c in range(30) for t in range(11)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = prefix_trie.coded(d)
    assert sorted((r.conv_id, r.pos) for r in turns.collect()) == sorted((c, t + 1) for c, t, *_ in rows)
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("len"))
    nodes, ends = prefix_trie.trie(turns, lengths)
    assert nodes.count() == 1 + 2 * 11
    got = {(r.depth, r.node): r.ends_sha256 for r in prefix_trie.ends_digests(ends).collect()}
    assert got == {(11, c): sha(",".join(map(str, range(c, 30, 2)))) for c in (0, 1)}


def test_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        words = rng.integers(0, 2**63, (n, 4)).astype(np.uint64)
        table = exact_dedup.PerfectHash(words)
        assert sorted(table.slots(words)) == list(range(n)) and len(table) == n
        again = exact_dedup.PerfectHash.load(*table.dump())
        assert list(again.slots(words)) == list(table.slots(words))
        other = again.slots(rng.integers(0, 2**63, (50, 4)).astype(np.uint64))
        assert ((other >= -1) & (other < max(n, 1))).all()


def test_perfect_hash_without_levels(monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEVELS", 1)
    words = np.arange(400, dtype=np.uint64).reshape(100, 4)
    table = exact_dedup.PerfectHash.load(*exact_dedup.PerfectHash(words).dump())
    assert len(table.rest) and sorted(table.slots(words)) == list(range(100))
    assert set(table.slots(words + np.uint64(10**6))) <= set(range(-1, 100))


@pytest.mark.parametrize("history", ["doc_id % 2 = 0", "true", "false", "doc_id > 15", "CAST(NULL AS boolean)"])
def test_exact_dedup(spark, history, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SHARD", 5)
    texts = [None, "", "a", "a", " a", "A", "a\n", "ü", "x" * 100_000, "x" * 100_000, "b", "b", "b", "b", "c", "a", "", None, "d", "e", "b"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "a"), (16, ""), (None, "b"), (None, "only null"), (None, "only null"), (20, "b")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("?") for n in ("id", "at", "digest", "old", "n", "kept", "member")}).repartition(3)
    got = exact_dedup.decided(d, F.expr(history)).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(sha(t or ""), []).append(i)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text_sha256) for r in got) == sorted((i is not None, i or 0, sha(t or "")) for i, t in rows)
    for s, ids in groups.items():
        mine = [r for r in got if r.text_sha256 == s]
        best = max((i for i in ids if i is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in mine} == {(best, len(ids))}
        assert [r.doc_id for r in mine if r.kept] == [best]
    olds = {sha(t or "") for i, t in rows if eval({"doc_id % 2 = 0": "i is not None and i % 2 == 0", "true": "True", "false": "False", "doc_id > 15": "i is not None and i > 15"}.get(history, "False"))}
    assert all(r.member == (r.text_sha256 in olds) for r in got)
    assert exact_dedup.decided(d.limit(0), F.expr(history)).collect() == []


def damaged(rows):
    out = {}
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind == 0:
            continue
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out.setdefault(c, []).extend([(t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1))
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, r, x in rows:
        words = WORD.findall(x)
        out.append("blank" if not words else "duplicate" if (r, x) in seen else "truncated" if words[-1][-1] not in ".!?" else None)
        seen.add((r, x))
    return out


def cheapest(rows):
    """Of all audits, by search over (place, roles so far): the cost, then the audit that is ASCII-least, and its turns."""
    marks, best = faults(rows), None
    ok = re.compile(r"(s?(ua)*u?)?")
    stack = [(0, 0, "", "", ())]
    limit = 4 * len(rows)
    while stack:
        i, cost, audit, roles, told = stack.pop()
        if cost > limit or not ok.fullmatch(roles) or best and (cost > best[0]):
            continue
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, told)
        if not audit.endswith("II"):
            stack += [(i, cost + 3, audit + "I", roles + w[0], (*told, w + ":")) for w in ("user", "assistant")]
        if i < len(rows):
            _, r, x = rows[i]
            stack.append((i + 1, cost + 4, audit + "D", roles, told))
            if marks[i] not in ("blank", "duplicate"):
                more = 3 if marks[i] else 0
                stack.append((i + 1, cost + more, audit + "K", roles + (r[:1] or "-"), (*told, f"{r}:{x}")))
                stack += [(i + 1, cost + more + 3, audit + "R", roles + w[0], (*told, f"{w}:{x}")) for w in ("user", "assistant")]
    return best


def test_repair_of_every_short_conversation(spark):
    rows, c = [], 0
    kinds = [("user", "a."), ("assistant", "b."), ("system", "c."), ("user", "cut"), ("tool", "d."), ("user", " ")]
    for n in range(1, 5):
        for pick in itertools.product(kinds, repeat=n):
            if n < 4 or zlib.crc32(str(pick).encode()) % 4 == 0:
                rows += [(c, t, r, x) for t, (r, x) in enumerate(pick)]
                c += 1
    got = turn_repair.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    turns = by_conv(rows)
    assert len(got) == len(turns)
    for r in got:
        own = [x[1:] for x in turns[r.conv_id]]
        assert (r.cost, r.audit, tuple(r.repaired)) == cheapest(own)


def test_repair(spark, folder):
    left = damaged(talks())
    want = {}
    for c in {r[0] for r in talks()}:
        rows = left.get(c, [])
        marks, turns = faults(rows), [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, told = cheapest(rows) if len(rows) < 9 else (None, None, None)
        want[c] = (gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit, told)
    got = queries.op13_turn_repair(spark, folder).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.conv_id]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal) == w[:5], r.conv_id
        if w[5] is not None:
            assert (r.cost, r.audit, r.repaired_sha256) == (w[5], w[6], sha("\n".join(w[7])))


def test_repair_of_nothing(spark, conversations):
    assert turn_repair.repaired(turn_repair.damaged(conversations.limit(0))).collect() == []

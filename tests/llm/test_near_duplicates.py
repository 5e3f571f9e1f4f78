"""Which documents stay where ids are missing or repeated, and which pairs count as near-duplicates."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from epochal.llm import simhash


def prose(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_ids_do_not_join_components(spark):
    rng = random.Random(1)
    a, b, c, d, e, f = (prose(rng, 60) for _ in range(6))
    rows = [(None, a), (None, b), (7, c), (7, d), (7, d), (3, e), (9, e), (9, f), (None, e), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(repr, (tuple(r) for r in simhash.representatives(df).collect())))
    assert got == sorted(map(repr, [(None, a), (None, b), (7, c), (7, d), (3, e), (9, f), (None, None)]))


def brute(docs):
    """Ids that stay by all pairs, whatever their fingerprints; pairs of different sets of shingles."""
    sets, holders = [], {}
    for k, (_, t) in enumerate(docs):
        w = (t or "").lower().split()
        sets.append(frozenset(xxhash.xxh64_intdigest(" ".join(w[k : k + 5]).encode(), 42) for k in range(max(1, len(w) - 4))) if w else frozenset())
    of = {}
    for k, s in enumerate(sets):
        of.setdefault(s, []).append(k)
    distinct = list(of)
    for k, s in enumerate(distinct):
        for h in s:
            holders.setdefault(h, []).append(k)
    root, pairs = list(range(len(distinct))), []

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(distinct):
        both = Counter(j for h in a for j in holders[h] if j < i)
        for j, n in both.items():
            if n >= 0.8 * (len(a) + len(distinct[j]) - n) - 1e-9:
                pairs.append((i, j))
                root[top(i)] = top(j)
    least = {}
    for i, s in enumerate(distinct):
        least[top(i)] = min(*(docs[k][0] for k in of[s]), least.get(top(i), docs[of[s][0]][0]))
    return sorted(least.values()), [(distinct[i], distinct[j]) for i, j in pairs]


def within(pairs, radius=11, second=20, prints=3):
    """How many pairs the fingerprints have."""
    found = 0
    for pair in pairs:
        h = [np.array(sorted(s), np.uint64) for s in pair]
        d = [(simhash.majority(simhash._again(h[0], k)) ^ simhash.majority(simhash._again(h[1], k))).bit_count() for k in range(prints)]
        found += any(x <= radius and y <= second for x, y in zip(d, d[1:] + d[:1]))
    return found


@pytest.mark.parametrize("bucket", [1000, 8])
def test_pipeline_links_changed_words(spark, monkeypatch, bucket):
    import corpus_pipeline

    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "SETS", bucket)
    rng = random.Random(5)
    docs = []
    for k in range(30):
        words = prose(rng, 200).split()
        docs.append((len(docs), " ".join(words)))
        for _ in range(20 if k == 0 else 2):
            changed = list(words)
            for at in rng.sample(range(200), rng.randint(1, 7)):
                changed[at] = "changed"
            docs.append((len(docs), " ".join(changed)))
    want, pairs = brute(docs)
    assert len(pairs) > 50 and within(pairs) >= 0.97 * len(pairs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == want


def test_masks_cover():
    """Whatever places differ, up to the radius, some mask has none of them."""
    rng = random.Random(2)
    for radius in (0, 4, 11, 14):
        for family in (0, 1, 2):
            found = simhash.masks(radius, family)
            assert all(m for m in found)
            for _ in range(300):
                differ = sum(1 << k for k in rng.sample(range(64), radius))
                assert any(not m & differ for m in found), (radius, family)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_near_duplicates_of_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    want, pairs = brute([tuple(r) for r in docs.collect()])
    got = sorted(r.doc_id for r in simhash.representatives(docs).collect())
    print("pairs", len(pairs), "within a fingerprint", within(pairs), "by one alone", within(pairs, prints=1), "kept", len(got), len(want))
    assert within(pairs) >= 0.95 * len(pairs)
    assert not set(want) - set(got) and len(set(got) - set(want)) <= 0.05 * len(pairs)


def test_a_large_group_meets_its_pivot_first(spark, monkeypatch):
    """Components over SETS sets: those like the pivot are connected by it, chains of others by pieces."""
    monkeypatch.setattr(simhash, "SETS", 4)
    rng = random.Random(9)
    words, docs = prose(rng, 300).split(), []
    for k in range(40):  # a chain: each text differs from the one before by a word
        docs.append((k, " ".join(words)))
        words[(k * 7) % 300] = f"x{k}"
    docs += [(100 + k, prose(rng, 100)) for k in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.representatives(df).collect()) == brute(docs)[0] == [0, 100, 101, 102, 103, 104]

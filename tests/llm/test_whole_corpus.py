"""What is learned from the whole corpus: discounts of n-grams."""

import random

from epochal.llm import ngram_trie


def test_scores_do_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[min(399, int(rng.expovariate(0.02)))] for _ in range(120)) + f" only{k} only{k}", k % 10 == 0) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = {}
    for size in (10**9, 20_000, 3_000):
        monkeypatch.setattr(ngram_trie, "BLOCK_BYTES", size)
        for parts in (1, 3):
            got[size, parts] = {r.doc_id: r.score for r in ngram_trie.score(df.repartition(parts)).collect()}
    first = got[10**9, 1]
    assert len(first) == 200
    worst = max(abs(s[d] - first[d]) / abs(first[d]) for s in got.values() for d in first)
    assert worst < 1e-9, worst

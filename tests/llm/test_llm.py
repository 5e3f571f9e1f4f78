"""Each operator against brute force, a library, or held-out rows, with the rows that usually break things."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from epochal.llm import bpe, langid, licenses, mixing, ngram_trie, quality, queries, simhash, token_counts, topk, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    rng = random.Random(4)
    words = "the of and haus baum über été señor data water 123 x's don't ǘ 日本語 <|endoftext|> İ Ünder mit".split()
    long_ = " ".join(rng.choice(words) for _ in range(30_000))
    some = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(30)]
    base = " ".join(rng.choice(words) for _ in range(60))
    return [
        None, "", " ", "\n\n", "a", "  two  spaces \t tab\r\n", base, base, base + " tail", base.replace("haus", "HAUS"), long_, "MIT License\nmit license MIT-LICENSE", "same line here\nsame line here\nother\nsame line here",
        "Released under the MIT License.\nGNU General Public License version 3", " nbsp em \x1c fs", "<|endoftext|>a <|endoftext|>", "x" * 5000, " ".join(["one two three four five six seven eight"] * 6),
        # a notice wrapped over lines
        "some code of ours\n\nPermission is hereby granted, free of charge,\nto any person obtaining a copy of\nthis software and associated\ndocumentation files\n" + "and more words follow here " * 30, *some,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "de", None][k % 3], ["a", "b", None, "z"][k % 4], 7) for k, t in enumerate(texts())]
    rows += [(5, rows[5][1], "en", "a", 7), (None, "null id here", "en", "b", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # extra columns whose names clash with results
    return d.withColumns({"n_tokens": F.lit("?"), "score": F.lit(1), "kept": F.lit("?"), "copies": F.lit("?"), "size": F.lit("?"), "id": F.lit("?"), "fp": F.lit("?"), "n_words": F.lit("?"), "decoded": F.lit("?")}).repartition(3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


def both(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_token_counts(docs, library):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, queries.tokenizer()).collect())
    want = sorted((i if i is not None else -1, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in both(docs))
    assert got == want
    assert token_counts.count_tokens(docs.limit(0), queries.tokenizer()).count() == 0


def test_bpe_round_trip(docs, library):
    out = bpe.encode(docs, queries.tokenizer())
    assert set(docs.columns) - {"n_tokens", "decoded"} <= set(out.columns)
    for r in out.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(np.frombuffer(r.token_ids, "<u4")) == ids
        assert r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False) == (r.text or "")
    d = {r.doc_id: r for r in bpe.digests(out.where("doc_id = 6")).collect()}[6]
    ids = library.encode(texts()[6], add_special_tokens=False).ids
    assert d.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert bpe.encode(docs.limit(0), queries.tokenizer()).count() == 0


def test_whole_tokens_are_proved():
    from epochal.llm.bytebpe import ByteBpe

    b = ByteBpe.load(queries.tokenizer())
    whole = token_counts.whole_tokens(b)
    assert 40_000 < len(whole) <= 50_257
    assert all(len(b.merge(t)) == 1 for t in list(whole)[:500])


def test_language_held_out(spark):
    out = queries.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = out.where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 100
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(docs):
    model = langid.train(docs.where("lang is not null").select("doc_id", "text", "lang"))
    out = langid.predict(docs, model)
    assert out.columns.count("score") == 1
    for r in out.collect():
        known = r.text and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not known)
        assert r.lang_pred in ("und", "de", "en")
    assert langid.predict(docs.limit(0), model).count() == 0
    none = langid.train(docs.where("lang = 'none'").select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def test_elias_fano():
    rng = np.random.default_rng(1)
    for values in (np.sort(rng.integers(0, 10**7, 3000)), np.arange(50), np.array([5]), np.sort(rng.integers(0, 30, 500))):
        n, bits, low, high = ngram_trie.EliasFano.build(values)
        e = ngram_trie.EliasFano(n, bits, low, high)
        assert (e.get(np.arange(n)) == values).all()
        x = np.concatenate([values, values + 1, [0, 10**8, -1]])
        at = e.find(x, np.zeros(len(x), int), np.full(len(x), n))
        there = np.isin(x, values)
        assert ((at >= 0) == there).all() and (values[at[there]] == x[there]).all()


def brute_tokens(t):
    return [w.translate(UPPER) for w in WORD.findall(t)]


def test_language_model(docs, monkeypatch):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    rows = docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False)).alias("held_out"), "score")
    out = ngram_trie.score(rows).collect()
    count = Counter()
    for i, t in both(docs):
        if not held(i):
            count.update([*brute_tokens(t), ""])
    n, v = sum(count.values()), len(count)
    want = sorted((-1 if i is None else i, len(w := [*brute_tokens(t), ""]), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)) for i, t in both(docs))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out)
    assert got == want
    assert {r.train_tokens for r in out} == {n}
    assert all(r.score <= 1e-9 for r in out)
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    # the same in many blocks and shards
    monkeypatch.setattr(ngram_trie, "BLOCK_BYTES", 20_000)
    split = {(r.doc_id, r.n_tokens): r for r in ngram_trie.score(rows).collect()}
    for r in out:
        s = split[(r.doc_id, r.n_tokens)]
        assert s.n_known == r.n_known and abs(s.base_score - r.base_score) < 1e-6 * (1 + abs(r.base_score))
    assert ngram_trie.score(rows.limit(0)).count() == 0


def brute_model(docs, order=3):
    """log10 probability of a text by dictionaries: discounted shares, quantised like the trie's, mixed with lower orders."""
    train = [[*brute_tokens(t), "\0end"] for t, held in docs if not held]
    words = Counter(w for t in train for w in t)
    n, v = sum(words.values()), len(words)
    counts, off = {}, {}
    for k in range(2, order + 1):
        counts[k] = Counter()
        for t in train:
            padded = ["\0start", *t]
            counts[k].update(tuple(padded[i : i + k]) for i in range(len(padded) - k + 1))
        off[k] = ngram_trie.discounts(ngram_trie.counts_of_counts(np.array(list(counts[k].values()) or [0])))
    follow = {k: {} for k in counts}
    for k in counts:
        for g, c in counts[k].items():
            follow[k].setdefault(g[:-1], []).append(c)
    rounded = lambda p: float(ngram_trie.VALUES[ngram_trie.quantise(np.array([p]))][0])

    def p_of(history, w):
        p = (words[w] + 0.1) / (n + 0.1 * (v + 1))
        for k in range(2, order + 1):
            context = tuple(history[-(k - 1) :])
            seen = follow[k].get(context)
            if len(context) == k - 1 and seen:
                c = counts[k][(*context, w)]
                share = rounded((c - off[k][min(c, 3)]) / sum(seen)) if c else 0.0
                p = share + rounded(sum(off[k][min(x, 3)] for x in seen) / sum(seen)) * p
        return p

    def score(t):
        history, total = ["\0start"], 0.0
        for w in [*brute_tokens(t), "\0end"]:
            total += math.log10(p_of(history, w))
            history.append(w)
        return total

    return score, p_of, [*words, "\0unseen"]


@pytest.mark.parametrize("size", [10**9, 3000])
def test_language_model_against_dictionaries(docs, monkeypatch, size):
    monkeypatch.setattr(ngram_trie, "BLOCK_BYTES", size)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    few = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 10_000)
    rows = few.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False)).alias("held_out"))
    score, p_of, words = brute_model([(t, held(i)) for i, t in both(few)])
    want = sorted((str(i), round(score(t), 6)) for i, t in both(few))
    for parts in (1, 2, 8):
        got = sorted((str(r.doc_id), round(r.score, 6)) for r in ngram_trie.score(rows.repartition(parts)).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert max(abs(g[1] - w[1]) for g, w in zip(got, want)) < 2e-6
    # the probabilities of all words and an unseen one, given a context, add up to 1 but for the rounding of shares
    for history in (["\0start"], ["\0start", "the"], ["haus", "baum"], ["nowhere", "of"]):
        assert abs(sum(p_of(history, w) for w in words) - 1) < 0.01


def test_language_model_held_out(spark):
    """On texts that it hasn't seen, contexts bring the model above the base."""
    out = queries.op3_lm_scores(spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert out.s > 0.95 * out.b


def test_convolutions_by_hand():
    """The answers through tables of byte pairs are those of plain convolutions."""
    rng = np.random.default_rng(1)
    filters = [rng.normal(0, 1, (w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS]
    model = langid.Model(["a", "b", "c"], filters, rng.normal(0, 0.1, (langid.FILTERS * 3, 3)).astype(np.float32), rng.normal(0, 1, 3).astype(np.float32))
    words = ["short", "x", "Über " * 30, "more than one window " * 40, "é" * 500]
    langs, scores = langid.Predictor(model)(words)
    for text, lang, score in zip(words, langs, scores):
        raw, z, weights = text.lower().encode(), [], []
        for s in range(0, len(raw), langid.LENGTH):
            part = raw[s : s + langid.LENGTH]
            weights.append(len(part) / langid.LENGTH)
            part = part.ljust(langid.LENGTH, b"\0")
            hidden = np.concatenate([np.max([sum(f[j][part[i + j]].astype(float) for j in range(len(f))) for i in range(langid.LENGTH - len(f) + 1)], axis=0) for f in filters])
            z.append(np.maximum(hidden, 0) @ model.weights + model.bias)
        z = np.average(z, axis=0, weights=weights)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert lang == model.languages[int(p.argmax())] and abs(score - p.max()) < 1e-4


def test_urls(spark):
    pages = [
        (1, "http://Example.ORG/es/x?q#f"), (2, "https://a.example.org/en/12"), (3, "http://other.org/es/1"), (4, "ftp://x.com/fr/"), (5, "http://x.com/de/5#a"), (6, None), (7, "no scheme"), (8, "http://notexample.org/es/"), (9, "http://"), (10, "http://bad.net/a"), (11, "http://bad.net/b"),
        (12, "http://good.net/"), (1, "http://Example.ORG/es/x?q#f"), (13, "http://h?x=/de/"), *[(100 + k, f"http://bad.net/{k}") for k in range(40)], *[(200 + k, f"http://good.net/{k}") for k in range(40)],
    ]
    labels = [(100 + k, 1) for k in range(40)] + [(200 + k, 0) for k in range(40)] + [(999, 1), (10, None)]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("?"))
    out = {r.page_id: r for r in urls.judge(df, spark.createDataFrame(labels, "page_id long, bad int"), queries.URL_RULES).collect()}
    assert len(out) == len({p for p, _ in pages})
    assert (out[1].host, out[1].path, out[1].rule, out[1].verdict) == ("example.org", "/es/x", "example.org/es/", "block")
    assert (out[2].rule, out[2].verdict) == ("example.org/en/1", "block")
    assert (out[3].rule, out[3].verdict) == ("org/", "allow")
    assert (out[4].rule, out[4].verdict) == ("com/fr/", "allow")
    assert (out[5].rule, out[5].verdict) == ("com/de/", "block")
    assert (out[6].host, out[6].path, out[6].rule, out[6].verdict) == ("", "", None, "allow")
    assert (out[7].host, out[8].rule, out[9].host) == ("", "org/", "")
    assert (out[13].host, out[13].path) == ("h", "")
    assert out[11].verdict == "block" and out[12].verdict == "allow"
    assert urls.judge(df.limit(0), spark.createDataFrame([], "page_id long, bad int"), queries.URL_RULES).count() == 0


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(0, 1, (700, 9)).astype("float32")
    v[300:500] = v[300]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(1000, None), (1001, [None] * 9), (1002, [float("nan")] * 9), (None, [0.0] * 9), (1003, [float("inf")] + [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("?"))
    monkeypatch.setattr(topk, "CHUNK", 100)
    monkeypatch.setattr(topk, "QUERIES", 6)
    use = topk.usable(df)
    got = sorted(tuple(r) for r in topk.top_k(use, use.where("id % 50 = 0"), 5).collect())
    q = np.floor(256 * v.astype(float))
    want = []
    for i in range(0, 700, 50):
        s = q @ q[i]
        order = sorted((j for j in range(700) if j != i), key=lambda j: (-s[j], j))[:5]
        want += [(i, k + 1, j, int(s[j])) for k, j in enumerate(order)]
    assert got == sorted(want)
    # components far beyond what doubles add up exactly, and repeated rows
    large = np.rint(rng.normal(0, 1, (60, 4)) * 2.0 ** rng.integers(0, 34, (60, 4)))
    large[7] = large[50]
    rows = [(i, [float(x) / 256 for x in r]) for i, r in enumerate(large)] + [(50, [float(x) / 256 for x in large[50]]), (90, [1e16, 1.0, 0.0, 0.0])]
    use_large = topk.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    got = sorted(tuple(r) for r in topk.top_k(use_large, use_large.where("id % 50 = 0"), 5).collect())
    want = []
    for i in (0, 50):
        s = sorted(((-sum(a * b for a, b in zip(v, whole[i][1])), j) for j, v in whole if j != i))[:5]
        want += [(i, k + 1, j, max(min(-x, 2**63 - 1), -(2**63))) for k, (x, j) in enumerate(s)]
    assert got == sorted(want)
    few = use.where("id < 3 or id = 50")
    assert topk.top_k(few, few.where("id = 50"), 5).count() == 3
    assert topk.top_k(use.limit(0), use.limit(0), 5).count() == 0


def brute_fingerprint(t):
    w = brute_tokens(t)
    if not w:
        return 0
    sh = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[top(i)] = top(j)
    return [top(i) for i in range(len(fps))]


def test_simhash(docs):
    rows = both(docs)
    fps = [brute_fingerprint(t) for _, t in rows]
    parts = components(fps, 4)
    least = {p: min((i for (i, _), q in zip(rows, parts) if q == p and i is not None), default=None) for p in parts}
    want = sorted((str(i), f, str(least[p])) for (i, _), f, p in zip(rows, fps, parts))
    got = sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in simhash.classes(docs).collect())
    assert got == want
    assert simhash.representatives(docs).columns == docs.columns
    assert simhash.classes(docs.limit(0)).count() == 0


def test_simhash_links_none_is_missed(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(simhash, "BUCKET", 20)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(10):
            x = b
            for k in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << k
            fps.add(x)
    near = base[0]
    fps |= {near ^ (1 << k) ^ (1 << j) for k in range(12) for j in range(k)}
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, 4)).collect()}
    parts = components(fps, 4)
    mine = [roots.get(s, s) for s in signed]
    pairs = set(zip(parts, mine))
    assert len({p for p, _ in pairs}) == len(pairs) == len({m for _, m in pairs})


def brute_license(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(UPPER))
    hits = [(k, lab) for p, lab in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    return len(w), len(hits), min((k for k, _ in hits), default=None), max((k for k, _ in hits), default=None), ",".join(sorted({lab for _, lab in hits}))


def brute_templates(t):
    labels, best = set(), 0.0
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.translate(UPPER))
    w = words(t)
    blocks = [(set(words(line)), 0) for line in t.split("\n")]
    for long in {len(x.split()) for _, x in licenses.TEMPLATES}:
        blocks += [(set(w[k : k + 2 * long]), long) for k in range(0, len(w), long)]
    for have, across in blocks:
        for lab, text in licenses.TEMPLATES:
            s = set(text.split())
            if across not in (0, len(text.split())):
                continue
            share = len(s & have) / len(s)
            if len(s & have) >= math.ceil(0.8 * len(s) - 1e-9):
                labels.add(lab)
                best = max(best, share)
    return labels, best


def test_licenses(docs):
    want = []
    for i, t in both(docs):
        n, hits, first, last, base = brute_license(t)
        labels, best = brute_templates(t)
        want.append((str(i), n, hits, str(first), str(last), base, ",".join(sorted(labels | set(filter(None, base.split(","))))), round(best, 9)))
    out = licenses.scan(docs)
    got = [(str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels, r.labels, round(r.score, 9)) for r in out.collect()]
    assert sorted(got) == sorted(want)
    assert [g for g in got if g[6] == "mit" and g[5] == ""]  # the wrapped one
    assert licenses.scan(docs.limit(0)).count() == 0


def test_mixing(docs):
    d = docs.select("doc_id", "source", mixing.n_words().alias("size"), F.lit("?").alias("copies"))
    out = mixing.with_copies(d).collect()
    sizes = Counter()
    for r in out:
        sizes[r.source] += r.size
    assert len(out) == docs.count()
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: weight[s] * level for s in open_}
    most = max(r.size for r in out)
    for s in order:
        rows = [r for r in out if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 * (1 + target[s]) and r.source_size == sizes[s] for r in rows)
        assert abs(sum(r.copies * r.size for r in rows) - target[s]) <= 2 * most
        assert all(0 <= r.copies <= 2 for r in rows)
    again = mixing.with_copies(d.repartition(7)).collect()
    assert sorted((str(r.doc_id), r.copies) for r in again) == sorted((str(r.doc_id), r.copies) for r in out)
    assert mixing.with_copies(d.limit(0)).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    hashed = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("hash")
    sized = mixing.with_copies(docs.select("doc_id", "source", "text", mixing.n_words().alias("size"), hashed), key=("doc_id", "hash")).collect()
    want = Counter({(str(r.doc_id), r.text): 0 for r in sized})
    for r in sized:
        want[str(r.doc_id), r.text] += r.copies
    got = mixed.collect()
    assert Counter((str(r.doc_id), r.text) for r in got) == +want
    assert {r.copies for r in got} == {"?"}  # the caller's column


def brute_quality(t):
    w = WORD.findall(t)
    win = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + j for k in range(len(w) - 7) if win[tuple(w[k : k + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality(docs):
    out = quality.judged(docs)
    assert out.columns.count("n_words") == out.columns.count("kept") == 1
    for r in out.collect():
        want = brute_quality(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed and r.failed_rule is None)
    kept = sorted(str(r.doc_id) for r in out.where("kept").collect())
    assert sorted(str(r.doc_id) for r in quality.accepted(docs).collect()) == kept
    assert quality.accepted(docs).columns == docs.columns
    assert quality.judged(docs.limit(0)).count() == 0


def test_quality_order_decides_cost_alone(docs):
    names = list(quality.RULES)
    one = docs.where("text is not null").select("doc_id", quality.first_failed(names).isNull().alias("a"), quality.first_failed(names[::-1]).isNull().alias("b"))
    assert one.where("a <> b").count() == 0
    assert sorted(n for n, _, _ in quality.plan(docs)) == sorted(names)

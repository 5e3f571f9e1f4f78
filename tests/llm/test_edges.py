"""Names that clash, addresses as hosts, and short notices that are wrapped."""

from pyspark.sql import functions as F

from epochal.llm import bpe, licenses, quality, queries, urls


def test_measures_keep_columns_of_any_name(spark):
    text = "\n".join(["the same eight words stand in this line", "x # y"] * 4)
    names = ("_words", "_lines", "_windows", "_sides", "_found", "_text")
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    clash = df.select("*", *[F.lit("mine").alias(c) for c in names])
    for work in (quality.measures, quality.judged):
        want = {r.doc_id: r.asDict() for r in work(df).collect()}
        got = {r.doc_id: r.asDict() for r in work(clash).collect()}
        assert got == {k: v | dict.fromkeys(names, "mine") for k, v in want.items()}
    assert quality.measures(clash.limit(0)).count() == 0
    both = quality.measures(df.union(df)).collect()
    assert sorted(map(repr, both)) == sorted(map(repr, quality.measures(df).collect() * 2))


def test_addresses_are_their_own_domains(spark):
    pages = [(k, f"http://10.0.2.3/{k}") for k in range(40)] + [(50 + k, f"http://a{k}.good.net/") for k in range(40)]
    pages += [(100, "http://99.88.2.3/"), (101, "http://[::1]:80/x"), (102, "http://u@10.0.2.3:8080/"), (103, "http://good.net.:80/"), (104, "http://1.2.3.4.net/")]
    labels = [(k, 1) for k in range(40)] + [(50 + k, 0) for k in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    out = {r.page_id: r for r in urls.judge(df, spark.createDataFrame(labels, "page_id long, bad int"), []).collect()}
    assert out[0].verdict == out[102].verdict == "block" and out[102].bad_rate == out[0].bad_rate
    assert {out[k].verdict for k in (50, 100, 101, 103, 104)} == {"allow"}
    assert out[100].bad_rate == out[101].bad_rate != out[103].bad_rate
    host = spark.createDataFrame([("host.:80",), ("h.co.uk..",), ("[::1]:80",), ("1.2.3.4",)], "h string")
    got = [tuple(r) for r in host.select(*[c.alias(k) for k, c in urls._levels(F.col("h")).items()]).collect()]
    assert got == [("host", "host", "host"), ("h.co.uk", "h.co.uk", "co.uk"), ("[::1]", "[::1]", "[::1]"), ("1.2.3.4",) * 3]


def test_short_notices_across_lines(spark):
    texts = ["licensed under the gnu lesser\ngeneral public license", "x\nlicensed under the creative commons\nattribution license\ny", "licensed under cc\nby sa 4 0", "nothing here", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert "lgpl" in out[0].labels.split(",") and out[0].score == 1
    assert "cc-by" in out[1].labels.split(",") and out[1].score == 1
    assert "cc-by-sa" in out[2].labels.split(",") and (out[3].labels, out[3].score, out[4].labels) == ("", 0, "")


def test_round_trips_are_told(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a few words, and more words"), (2, None), (3, "")], "doc_id long, text string")
    want = {r.doc_id: bytes(r.token_ids) for r in bpe.encode(df, queries.tokenizer()).collect()}
    monkeypatch.setattr(bpe, "KEPT_BYTES", 1)
    got = bpe.encode(df.repartition(1), queries.tokenizer(), check=True).collect()
    assert {r.doc_id: bytes(r.token_ids) for r in got} == want and all(r.round_trip for r in got) and "decoded" not in got[0].asDict()


def test_counts_without_strings(spark):
    """Rules count characters by what is left of a text; the same documents fail as by counting matches."""
    word = F.lit(r"[^\x20\x09-\x0D]+")
    n = F.regexp_count("text", word)
    plain = {
        "symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")) > 0.1 * n,
        "exclamations": F.regexp_count("text", F.lit("!")) > 0.3 * n,
        "capitals": F.regexp_count("text", F.lit(r"\p{Lu}")) > 0.5 * F.regexp_count("text", F.lit(r"\p{L}")),
        "few_letters": F.regexp_count("text", F.lit(r"\p{L}")) < 0.5 * F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")),
        "long_words": F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]{41,}")) > 0.1 * n,
    }
    odd = ["", "  \t\n", "!", "a ! b!", "ÀÉ𝔘 x", "𝔘𝔘 ÄB c d", "x" * 40, "x" * 41 + " y", "ab " * 9 + "x" * 130, "1 2 3 a", "# a b", "#$ " + "w " * 20, "# " + "w " * 9, "# " + "w " * 10, "É" * 41 + "\x0b!", "\0!!"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "doc_id long, text string")
    got = docs.select("text", *[quality.RULES[k]("text").alias(k) for k in plain], *[v.alias(f"_{k}") for k, v in plain.items()]).collect()
    for r in got:
        for k in plain:
            assert r[k] == r[f"_{k}"], (k, r.text)


def test_pieces_that_begin_with_a_null_character(spark):
    import numpy as np
    from tokenizers import Tokenizer

    texts = ["a \0bc", "bc \0bc", "\0bc", " bc", "", "  bc"]
    ids = bpe.Encoder(bpe.ByteBpe.load(queries.tokenizer())).encode(texts)
    whole = Tokenizer.from_file(queries.tokenizer())
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [whole.encode(t, add_special_tokens=False).ids for t in texts]

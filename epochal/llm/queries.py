"""The numbered queries over the driver's tables; each gets its rows through its operator."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, langid, licenses, mixing, ngram_trie, prefix_trie, quality, simhash, token_counts, topk, turn_repair, turns_sql, urls
from .common import LOWER, UPPER, read


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    learn = docs.where(F.coalesce(~held_out, F.lit(False)) & F.col("lang").isNotNull())
    model = langid.train(learn.select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), model).drop("text")


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return ngram_trie.score(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels table gives the outcomes of the pages whose page_id equals its doc_id."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return urls.judge(read(spark, sf_dir, "pages"), labels, URL_RULES)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 50 == 0), 5)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.classes(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer()))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words().alias("size"))
    out = mixing.with_copies(docs)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs).drop("text", "failed_rule")  # which rule came first depends on what the sample cost


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations begin with turns of the one whose id ends their block of 20, see prefix_trie.spliced."""
    nodes, ends = prefix_trie.trie(*prefix_trie.spliced(prefix_trie.coded(read(spark, sf_dir, "conversations"))))
    told = prefix_trie.ends_digests(ends).withColumnRenamed("node", "conv_id")
    return nodes.join(told, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose crc32(doc_id) is even are the history; the others are looked up in its index."""
    history = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return exact_dedup.decided(read(spark, sf_dir, "documents"), history).drop("member")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    found = turn_repair.repaired(turn_repair.damaged(conversations))
    found = found.select(F.col("conv_id").alias("c"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join("repaired", "\n"), 256).alias("repaired_sha256"))
    out = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_counts, op2_language_id, op3_lm_scores, op4_url_filters, op5_top_k, op6_simhash, op7_bpe, op8_license_scan, op9_source_mix, op10_quality_rules, op11_prefix_trie, op12_exact_dedup, op13_turn_repair]
    return {f.__name__: f for f in found}


def _license_sql() -> str:
    sets, lengths = [(label, sorted(set(text.split()))) for label, text in licenses.TEMPLATES], [len(text.split()) for _, text in licenses.TEMPLATES]
    words = lambda x: f"regexp_extract_all(translate({x}, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    rows = ", ".join(f"('{label}', {s!r}, {math.ceil(licenses.THRESHOLD * len(s) - 1e-9)}, {k})" for (label, s), k in zip(sets, lengths))
    each = ", ".join(f"({k})" for k in sorted(set(lengths)))
    phrase = lambda p: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))
    base = " UNION ALL ".join(f"SELECT r, i - 1 AS p, '{label}' AS label FROM pl WHERE {phrase(p)}" for p, label in licenses.PHRASES)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT r, doc_id, t, {words('t')} AS w FROM d),
        pl AS (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM m WHERE len(w) > 0), b AS ({base}), bb AS (SELECT r, count(*) AS n, min(p) AS first, max(p) AS last FROM b GROUP BY r),
        l AS (SELECT DISTINCT r, list_distinct({words('line')}) AS s, 0 AS across FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) UNION SELECT r, list_distinct(w[i:i + 2 * k - 1]), k FROM (SELECT r, w, k, unnest(generate_series(1, len(w), k)) AS i FROM m, (VALUES {each}) z(k))), t AS (SELECT * FROM (VALUES {rows}) v(label, s, least, words)),
        h AS (SELECT l.r, t.label, len(list_intersect(t.s, l.s)) / len(t.s) AS share FROM l, t WHERE len(list_intersect(t.s, l.s)) >= t.least AND across IN (0, t.words)), hh AS (SELECT r, max(share) AS score FROM h GROUP BY r),
        bl AS (SELECT r, string_agg(label, ',' ORDER BY label) AS x FROM (SELECT DISTINCT r, label FROM b) GROUP BY r), al AS (SELECT r, string_agg(label, ',' ORDER BY label) AS x FROM (SELECT r, label FROM b UNION SELECT r, label FROM h) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(bb.n, 0)::BIGINT AS n_base, bb.first::BIGINT AS first_word, bb.last::BIGINT AS last_word, coalesce(bl.x, '') AS base_labels, coalesce(al.x, '') AS labels, coalesce(hh.score, 0)::DOUBLE AS score
        FROM m LEFT JOIN bb USING (r) LEFT JOIN bl USING (r) LEFT JOIN al USING (r) LEFT JOIN hh USING (r)"""


_QUALITY_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    m AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM m WHERE len(w) >= 8)),
    c AS (SELECT r, count(DISTINCT i + k) AS c FROM (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1), (SELECT unnest(generate_series(0, 7)) AS k) GROUP BY r),
    x AS (SELECT doc_id, t, len(w)::BIGINT AS n, length(array_to_string(w, ''))::BIGINT AS chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS s, (len(l) - len(list_distinct(l)))::BIGINT AS dup, len(l) AS lines, coalesce(c, 0)::BIGINT AS c,
      len(regexp_extract_all(t, '!')) AS marks, len(regexp_extract_all(t, '\p{Lu}')) AS up, len(regexp_extract_all(t, '\p{L}')) AS letters, len(list_filter(w, lambda x: length(x) > 40)) AS long FROM m LEFT JOIN c USING (r)),
    y AS (SELECT *, n < 20 OR 100 * c > 30 * n AS base_failed FROM x)
    SELECT doc_id, n AS n_words, chars AS word_chars, s AS n_symbols, dup AS n_dup_lines, c AS n_repeat_words, base_failed,
      NOT (base_failed OR s > 0.1::DOUBLE * n OR dup > 0.3::DOUBLE * lines OR marks > 0.3::DOUBLE * n OR up > 0.5::DOUBLE * letters OR letters < 0.5::DOUBLE * chars OR long > 0.1::DOUBLE * n) AS kept FROM y"""


def oracle_sql() -> dict[str, str]:
    return {
        "op8_license_scan": _license_sql(),
        "op11_prefix_trie": turns_sql.TRIE,
        "op12_exact_dedup": turns_sql.DEDUP,
        "op13_turn_repair": turns_sql.REPAIR,
        "op10_quality_rules": _QUALITY_SQL,
        "op5_top_k": """
            WITH v AS (
              SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
              WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
              SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
            ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    }

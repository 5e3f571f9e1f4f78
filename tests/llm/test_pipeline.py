"""The pipeline's stages, each on its own input, against what their operators say."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    from epochal.llm import langid, mixing, quality, simhash

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    one = steps["quality"](spark, docs, SF)
    assert one.columns == names
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in quality.judged(docs).where("kept").collect())
    one.write.parquet(f"file://{tmp_path}/1")
    docs = spark.read.parquet(f"file://{tmp_path}/1")
    two = steps["language"](spark, docs, SF)
    assert two.columns == names and 0 < two.count() <= docs.count()
    model = langid.train(docs.where("lang is not null").select("doc_id", "text", "lang"))
    assert two.count() == langid.predict(docs, model).where(f"lang_pred <> 'und' and score >= {corpus_pipeline.LEAST_SCORE}").count()
    two.write.parquet(f"file://{tmp_path}/2")
    docs = spark.read.parquet(f"file://{tmp_path}/2")
    three = steps["near_duplicates"](spark, docs, SF)
    assert three.columns == names
    assert sorted(map(tuple, three.collect())) == sorted(map(tuple, simhash.representatives(docs).collect()))
    three.write.parquet(f"file://{tmp_path}/3")
    docs = spark.read.parquet(f"file://{tmp_path}/3")
    four = steps["mix"](spark, docs, SF)
    assert four.columns == names
    want = mixing.with_copies(docs.withColumn("size", mixing.n_words())).agg(F.sum("copies")).first()[0]
    assert four.count() == want
    five = steps["bpe"](spark, four, SF)
    assert five.count() == four.count() and {"token_ids", "n_tokens"} <= set(five.columns)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame([], docs.schema)
        assert stage(spark, docs, SF).count() == 0, name


def test_columns_that_clash_keep_their_values(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    mine = ["kept", "n_words", "_words", "_lines", "score", "lang_pred", "_hash", "_row", "key", "hash", "copies", "size", "target", "id", "fp"]
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in mine})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in mine), name


def test_run(spark):
    """The whole is what the stages give one after the other."""
    out = corpus_pipeline.run(spark, SF)
    got = sorted((r.doc_id, r.n_tokens, r.round_trip) for r in out.collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert got == sorted((r.doc_id, r.n_tokens, r.round_trip) for r in docs.collect())
    assert all(r[2] for r in got)

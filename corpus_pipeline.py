"""A pipeline over documents: quality rules, language, near-duplicates, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again
before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.llm import bpe, langid, mixing, quality, simhash
from epochal.llm.common import free, read, shared_dir
from epochal.llm.queries import tokenizer

#: A language is believed from this score on; documents without letters or below it go.
LEAST_SCORE = 0.4
#: Bytes of a batch of rows between the JVM and Python. Both sides hold a few, for each task; 64 MB is usual.
BATCH_BYTES = 8 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects: null, empty and wordless texts go, texts of any length are judged whole,
    repeated rows stay or go together, all columns keep their values, and an empty table gives an empty result."""
    return quality.accepted(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows of its own input; documents of no language that it has learned go, and texts that are null or
    have no letter. Repeated rows stay or go together; all columns keep their values; an empty table gives an empty result."""
    names = docs.columns
    model = langid.train(docs.where("lang is not null").select("doc_id", "text", "lang"))
    lang, score = free("lang_pred", names), free("score", names)
    out = langid.predict(docs, model, names=(lang, score))
    return out.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays: that of the smallest doc_id. Texts are linked if their distinct
    runs of five words have a Jaccard similarity of 0.8 or more and one of three SimHash fingerprints differs in 11 bits or fewer. Texts
    without words are alike, null ones too; rows of a null or repeated doc_id each stay if their texts aren't linked."""
    return simhash.representatives(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix emits it, by the weights of its source (null is a source of its own). Rows alike in
    doc_id and text are emitted together as often as all of them; texts without words go by their source's share."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids, n_tokens and round_trip: whether the ids decode to the text. A null text is an empty one;
    columns of docs that have one of these names are replaced; an empty table gives an empty result."""
    return bpe.encode(docs, tokenizer(), check=True)


STAGES = [("quality", quality_rules), ("language", language), ("near_duplicates", near_duplicates), ("mix", source_mix), ("bpe", tokens)]

#: The model of the language stage and the ids of the last one can't be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..plans.iterate import shared_dir

#: A word is a run of characters other than the ASCII white space below.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are lower-cased by these letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def free(name: str, taken: list[str]) -> str:
    """name, or one like it that is not among taken (as Spark compares names)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name = "_" + name
    return name


def keep(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: what follows doesn't depend on any executor's disk.

    Shuffle files go as soon as the table is written; a lost executor's part of them is made again meanwhile.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN_UP) if before is None else spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)

"""Queries by name, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as long: what two engines agree on."""
    kinds = {"double": lambda c: F.round(F.col(c) + 0.0, digits), "float": lambda c: F.round(F.col(c).cast("double"), digits)}
    whole = ("tinyint", "smallint", "int", "bigint")
    return df.select(*[kinds[t](c).alias(c) if t in kinds else F.col(c).cast("long").alias(c) if t in whole or t.startswith("decimal") else F.col(c) for c, t in df.dtypes])

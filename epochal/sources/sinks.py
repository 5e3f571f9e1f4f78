"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text(df: DataFrame, path: str, sep: str = " ", order: Sequence[str] = (), columns: Sequence[str] | None = None, mode: str = "errorifexists") -> None:
    """Records of values with a separator; order sorts them over all files, whose names follow the order."""
    df = df.select(*(columns or df.columns))
    if order:
        df = df.orderBy(*order)
    df.select(F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value")).write.mode(mode).text(path)


def parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), cluster_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """cluster_by sorts rows inside files, so that readers can skip by column statistics."""
    if partition_by:
        df = df.repartition(*partition_by)
    if cluster_by:
        df = df.sortWithinPartitions(*cluster_by)
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def parts(df: DataFrame, path: str, records: int, mode: str = "errorifexists") -> None:
    """Text files (df: value) of at most so many records."""
    df.select("value").write.mode(mode).option("maxRecordsPerFile", records).text(path)


def transposed(df: DataFrame, order: str, columns: Sequence[str], most: int = 1000) -> DataFrame:
    """A row for each column and a column for each row; rows are named by order and must not be over most."""
    rows = [r[0] for r in df.select(order).orderBy(order).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    long = df.select(F.col(order).alias("_r"), F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns])).alias("_x")).select("_r", "_x.*")
    return long.groupBy("variable").pivot("_r", rows).agg(F.first("v"))

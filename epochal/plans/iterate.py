"""Iteration to a fixed point: each round's table is written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set and Spark is one process, a folder of its own. A cluster must name one."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='epochal-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at


def dealt(df: DataFrame) -> DataFrame:
    """df as one side of a join whose sides both grow with the input: rows meet by a shuffle, neither side goes through the driver, however
    small it seems by the size of its files."""
    return df.hint("merge")


def settled(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """df written and read again: lineage is cut, and a lost executor costs no earlier round. The table of instead_of, an earlier
    round that nothing will read any more, is deleted then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    if instead_of is not None:
        discard(instead_of)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table that settled() wrote for df."""
    at = getattr(df, "_settled_at", None)
    if at:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

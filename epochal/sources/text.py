"""Text files of records: free format, fixed columns, delimited; with codes for what is missing."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import SHAPE

#: What a blank, a star, a point and anything else that is no number is read as.
CODES = {"blank": -1.0, "star": -1.0, "point": -1.0, "other": -1.0}


def value(text: Column, codes: dict[str, float] | None = CODES) -> Column:
    """A number, or its code; with codes None what is missing stays null."""
    t = F.trim(text)
    if codes is None:
        return t.try_cast("double")
    code = F.when(t.isNull() | (t == ""), codes["blank"]).when(t == "*", codes["star"]).when(t == ".", codes["point"]).otherwise(codes["other"])
    return F.coalesce(t.try_cast("double"), code)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Records without comments (from # on) and blank ones: value, file."""
    rows = spark.read.text(path).select(F.regexp_replace("value", r"#.*$", "").alias("value"), F.input_file_name().alias("file"))
    return rows.where(F.trim("value") != "")


def free(spark: SparkSession, path: str, names: Sequence[str], codes: dict[str, float] | None = CODES) -> DataFrame:
    """White space between values; a column for each of names, doubles."""
    parts = lines(spark, path).select(F.split(F.trim("value"), r"\s+").alias("_p"))
    return parts.select(*[value(F.get("_p", F.lit(k)), codes).alias(n) for k, n in enumerate(names)])


def delimited(spark: SparkSession, path: str, names: Sequence[str] | None = None, sep: str = ",", header: bool = False, codes: dict[str, float] | None = None, strings: Sequence[str] = ()) -> DataFrame:
    """A csv dialect; all columns but strings become numbers."""
    rows = spark.read.csv(path, sep=sep, header=header, quote='"', multiLine=False, schema=None if header or names is None else ", ".join(f"`{n}` string" for n in names))
    return rows.select(*[F.col(f"`{c}`") if c in strings else value(F.col(f"`{c}`"), codes).alias(c) for c in rows.columns])


def fixed(spark: SparkSession, path: str, columns: Sequence[tuple[str, int, int]], codes: dict[str, float] | None = CODES, strings: Sequence[str] = ()) -> DataFrame:
    """columns: name, first and last character (from 1)."""
    rows = spark.read.text(path)
    cut = lambda a, b: F.substring("value", a, b - a + 1)
    return rows.select(*[F.rtrim(cut(a, b)).alias(n) if n in strings else value(cut(a, b), codes).alias(n) for n, a, b in columns])


def matrix_list(spark: SparkSession, path: str) -> DataFrame:
    """A DL file (n=..., a data section with rows of a full matrix) as edges i, j, v of entries other than 0. Rows are numbered by their place in the file."""
    rows = spark.read.text(path, wholetext=True).select(F.lower("value").alias("t"))
    n = F.regexp_extract("t", r"n\s*=\s*(\d+)", 1).cast("int")
    cells = F.filter(F.split(F.regexp_extract("t", r"(?s)data:\s*(.*)", 1), r"\s+"), lambda x: x != "")
    cut = rows.select(n.alias("n"), F.posexplode(cells).alias("k", "x"))
    return cut.select((F.floor(F.col("k") / F.col("n")) + 1).alias("i"), (F.col("k") % F.col("n") + 1).cast("long").alias("j"), F.col("x").try_cast("double").alias("v")).where("v <> 0")


def objects(spark: SparkSession, path: str) -> DataFrame:
    """Spatial files: a header row (id, type, number of vertices, ...) before the rows of vertices: id, type, shape. Files are read whole, one a task."""
    def run(frames):
        for f in frames:
            out = []
            for text in f["value"]:
                rows = [[float(x) for x in p] for r in text.splitlines() if (p := r.partition("#")[0].split())]
                k = 0
                while k < len(rows):
                    ident, kind, n = (int(x) for x in rows[k][:3])
                    out.append((ident, kind, [{"x": p[0], "y": p[1]} for p in rows[k + 1 : k + 1 + n]]))
                    k += 1 + n
            yield pd.DataFrame(out, columns=["id", "type", "shape"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, f"id long, type int, shape {SHAPE}")


def character_counts(spark: SparkSession, path: str) -> DataFrame:
    """character, n."""
    return spark.read.text(path).select(F.explode(F.split("value", "")).alias("character")).where("character <> ''").groupBy("character").agg(F.count("*").alias("n"))


def length_counts(spark: SparkSession, path: str) -> DataFrame:
    """length of records, n."""
    return spark.read.text(path).groupBy(F.length("value").alias("length")).agg(F.count("*").alias("n"))


def hex_dump(spark: SparkSession, path: str, start: int = 0, count: int = 64) -> DataFrame:
    """file, hex: count bytes from start on."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.hex(F.substring("content", start + 1, count)).alias("hex"))


def record_counts(spark: SparkSession, path: str) -> DataFrame:
    """file, records: to hold against a catalogue."""
    return spark.read.text(path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("records"))


def catalogue_faults(counts: DataFrame, catalogue: DataFrame) -> DataFrame:
    """file, expected, found where they differ; catalogue: file (its last part), records."""
    got = counts.select(F.element_at(F.split("file", "/"), -1).alias("file"), F.col("records").alias("found"))
    return catalogue.select("file", F.col("records").alias("expected")).join(got, "file", "full_outer").where(~F.col("expected").eqNullSafe(F.col("found")))

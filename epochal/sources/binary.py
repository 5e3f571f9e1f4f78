"""Binary files: one file is read in one task, many files in parallel."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import SHAPE


def _decoded(spark: SparkSession, path: str, decode: Callable[[bytes], pd.DataFrame], schema: str) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                yield decode(content)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def dbf_fields(head: bytes) -> list[tuple[str, str, int]]:
    """Name, type and width of each field from the head of a dBase file."""
    size = struct.unpack_from("<H", head, 8)[0]
    out = []
    for at in range(32, size - 1, 32):
        if head[at] == 0x0D:
            break
        out.append((head[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(head[at + 11]), head[at + 16]))
    return out


def dbf(spark: SparkSession, path: str) -> DataFrame:
    """Tables of dBase III; all files have the fields of the first. Numeric fields are doubles, deleted rows left out."""
    first = spark.read.format("binaryFile").load(path).orderBy("path").select(F.substring("content", 1, 65535).alias("head")).first()
    fields = dbf_fields(bytes(first.head))
    schema = ", ".join(f"`{n}` {'double' if t in 'NF' else 'string'}" for n, t, _ in fields)

    def decode(content: bytes) -> pd.DataFrame:
        rows, head, width = struct.unpack_from("<IHH", content, 4)
        table = np.frombuffer(content, np.uint8, rows * width, head).reshape(rows, width)
        table = table[table[:, 0] != 0x2A]
        out, at = {}, 1
        for n, t, w in fields:
            text = [bytes(r).decode("latin-1").strip() for r in table[:, at : at + w]]
            out[n] = pd.to_numeric(pd.Series(text), errors="coerce") if t in "NF" else text
            at += w
        return pd.DataFrame(out)

    return _decoded(spark, path, decode, schema)


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """ESRI shapes: id (number of the record), part, type (1 point, 2 line, 3 polygon), shape."""

    def decode(content: bytes) -> pd.DataFrame:
        out, at = [], 100
        while at + 8 <= len(content):
            number, words = struct.unpack_from(">ii", content, at)
            body = at + 8
            kind = struct.unpack_from("<i", content, body)[0]
            if kind % 10 == 1:
                x, y = struct.unpack_from("<dd", content, body + 4)
                out.append((number, 0, 1, [{"x": x, "y": y}]))
            elif kind % 10 in (3, 5):
                parts, points = struct.unpack_from("<ii", content, body + 36)
                starts = [*struct.unpack_from(f"<{parts}i", content, body + 44), points]
                xy = np.frombuffer(content, "<f8", 2 * points, body + 44 + 4 * parts).reshape(-1, 2)
                out += [(number, k, 2 if kind % 10 == 3 else 3, [{"x": float(x), "y": float(y)} for x, y in xy[a:b]]) for k, (a, b) in enumerate(zip(starts, starts[1:]))]
            at = body + 2 * words
        return pd.DataFrame(out, columns=["id", "part", "type", "shape"])

    return _decoded(spark, path, decode, f"id long, part int, type int, shape {SHAPE}")


def elevation_grid(spark: SparkSession, path: str, rows: int, columns: int, left: float, top: float, dx: float, dy: float, lon: tuple[float, float] = (-180, 180), lat: tuple[float, float] = (-90, 90), missing: int = -9999) -> DataFrame:
    """lon, lat, elevation of a grid of big-endian 16-bit numbers, rows from the north; missing values are left out."""

    def decode(content: bytes) -> pd.DataFrame:
        grid = np.frombuffer(content, ">i2", rows * columns).reshape(rows, columns)
        x, y = left + dx * np.arange(columns), top - dy * np.arange(rows)
        i, j = np.nonzero(((y >= lat[0]) & (y <= lat[1]))[:, None] & ((x >= lon[0]) & (x <= lon[1]))[None, :] & (grid != missing))
        return pd.DataFrame({"lon": x[j], "lat": y[i], "elevation": grid[i, j].astype("int32")})

    return _decoded(spark, path, decode, "lon double, lat double, elevation int")


def stata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stata files; schema names the columns that are taken."""
    names = [p.split()[0] for p in schema.split(",")]
    return _decoded(spark, path, lambda content: pd.read_stata(io.BytesIO(content), convert_categoricals=False)[names], schema)

"""Self-describing binary clouds, matrices and image files."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import SCALARS

#: (name, offset, type code, count)
Layout = Sequence[tuple[str, int, int, int]]


def numpy_layout(layout: Layout, step: int) -> np.dtype:
    return np.dtype({"names": [f[0] for f in layout], "formats": [(SCALARS[t][0], (n,)) if n > 1 else SCALARS[t][0] for _, _, t, n in layout], "offsets": [f[1] for f in layout], "itemsize": step})


def packed(spark_types: Sequence[tuple[str, int]]) -> tuple[list[tuple[str, int, int, int]], int]:
    """A layout without gaps for (name, type code) fields, and its step."""
    out, at = [], 0
    for name, code in spark_types:
        out.append((name, at, code, 1))
        at += np.dtype(SCALARS[code][0]).itemsize
    return out, at


def to_blobs(df: DataFrame, layout: Layout, step: int, rows: int = 10_000) -> DataFrame:
    """blob, n, start: runs of `rows` points of df (idx and the layout's fields) as bytes; start is the first idx of the run."""
    names = [f[0] for f in layout]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a = np.zeros(len(b), dtype=numpy_layout(layout, step))
            for n in names:
                a[n] = b[n].to_numpy()
            yield pd.DataFrame({"start": [int(b["idx"].iloc[0])], "n": [len(b)], "ids": [b["idx"].to_numpy().astype("<i8").tobytes()], "blob": [a.tobytes()]}) if len(b) else pd.DataFrame({"start": [], "n": [], "ids": [], "blob": []})

    return df.select("idx", *names).mapInPandas(run, "start long, n long, ids binary, blob binary")


def from_blobs(df: DataFrame, layout: Layout, step: int, wanted: Sequence[str] | None = None, swap: bool = False) -> DataFrame:
    """idx and the wanted fields (those of them that the layout has) of blobs; swap reverses the bytes of every scalar."""
    have = {f[0]: f for f in layout}
    names = [n for n in (wanted or have) if n in have]
    schema = T.StructType([T.StructField("idx", T.LongType()), *(T.StructField(n, T.ArrayType(SCALARS[have[n][2]][1]) if have[n][3] > 1 else SCALARS[have[n][2]][1]) for n in names)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, blob in zip(b["ids"], b["blob"], strict=True):
                a = np.frombuffer(blob, dtype=numpy_layout(layout, step))
                if swap:
                    a = a.byteswap()
                yield pd.DataFrame({"idx": np.frombuffer(ids, dtype="<i8"), **{n: list(a[n]) if have[n][3] > 1 else a[n].astype(np.int64) if SCALARS[have[n][2]][0][0] in "iu" else a[n] for n in names}})

    return df.mapInPandas(run, schema)


def matrix_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """i, j, v: the matrix with a row per idx and a column per field."""
    cells = F.explode(F.array(*(F.struct(F.lit(j).cast("long").alias("j"), F.col(c).cast("double").alias("v")) for j, c in enumerate(cols))))
    return df.select(F.col("idx").alias("i"), cells.alias("c")).select("i", "c.j", "c.v")


def from_cells(cells: DataFrame, cols: Sequence[str]) -> DataFrame:
    return cells.groupBy(F.col("i").alias("idx")).agg(*(F.max(F.when(F.col("j") == j, F.col("v"))).alias(c) for j, c in enumerate(cols)))


def save_matrix(cells: DataFrame, path: str) -> None:
    cells.write.parquet(path)


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def encode_png(a: np.ndarray) -> bytes:
    """8-bit grey or RGB(A) PNG."""
    h, w = a.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[1 if a.ndim == 2 else a.shape[2]]
    raw = b"".join(b"\0" + line.tobytes() for line in a.astype(np.uint8))

    def chunk(tag: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> np.ndarray:
    """(h, w, channels) of an 8-bit, non-interlaced PNG."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    f, idat, head = io.BytesIO(data[8:]), b"", None
    while chunk := f.read(8):
        n, tag = struct.unpack(">I4s", chunk)
        body = f.read(n)
        f.read(4)
        if tag == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif tag == b"IDAT":
            idat += body
    w, h, depth, kind, _, _, interlaced = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(kind)
    if depth != 8 or interlaced or channels is None:
        raise ValueError("only 8-bit grey or colour PNG without interlace")
    raw = np.frombuffer(zlib.decompress(idat), dtype=np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h, w * channels), dtype=np.int64)
    for y in range(h):
        kind, line = int(raw[y, 0]), raw[y, 1:].astype(np.int64)
        up = out[y - 1] if y else np.zeros_like(line)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            cur = out[y]
            for x in range(len(line)):
                a = cur[x - channels] if x >= channels else 0
                b, c = up[x], up[x - channels] if x >= channels else 0
                if kind == 1:
                    p = a
                elif kind == 3:
                    p = (a + b) // 2
                else:
                    q = a + b - c
                    pa, pb, pc = abs(q - a), abs(q - b), abs(q - c)
                    p = a if pa <= pb and pa <= pc else b if pb <= pc else c
                cur[x] = (line[x] + p) & 255
    return out.reshape(h, w, channels)


def read_images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """path, row, col, c0 .. c3 (null where there is no such channel) of all images of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                a = decode_png(content)
                r, c = np.indices(a.shape[:2])
                cols = {f"c{i}": a[..., i].ravel() if i < a.shape[2] else None for i in range(4)}
                yield pd.DataFrame({"path": p, "row": r.ravel(), "col": c.ravel(), **cols})

    return files.mapInPandas(run, "path string, row long, col long, c0 long, c1 long, c2 long, c3 long")


def decal_channels(pixels: DataFrame) -> DataFrame:
    """The pixels of a decal; it must have four channels."""
    if pixels.filter("c3 is null").limit(1).count():
        raise ValueError("a decal image needs an alpha channel")
    return pixels

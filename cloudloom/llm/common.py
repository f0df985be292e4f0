"""Shared helpers: staged tables, size-checked broadcasts and byte/word hashing in numpy."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns of the query contracts.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ITEM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CASED_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Upper-case characters other than A-Z.
OTHER_UPPER = r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Text bytes handled at once inside a Python worker.
CHUNK_BYTES = 3 << 20
#: Bytes up to which a small side may be broadcast (measured, never assumed).
BROADCAST_BYTES = 32 << 20

_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session; a private one is set only where none is named and all tasks run in this process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cloudloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends, lost executors cost nothing.

    The folder is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/cloudloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    gc.collect()
    jvm.System.gc()  # lets Spark drop the shuffle files of the finished step
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: all that was made of them must be staged itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df (already staged) marked for broadcast if its measured size is within limit, else df itself.

    Size is counted as the text form of every row plus 64 bytes a row, an upper estimate of the hashed relation.
    """
    size = df.select(F.sum(F.length(F.to_json(F.struct(*df.columns))) + 64)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def held(df: DataFrame, **cols: Column) -> DataFrame:
    """df with columns that are computed once a row. Catalyst inlines a projected expression wherever it is used, even inside a lambda; a generator of one row stops that."""
    one = F.explode(F.array(F.struct(*(c.alias(n) for n, c in cols.items()))))
    return df.select("*", one.alias("__held")).select(*df.columns, *(F.col(f"__held.{n}").alias(n) for n in cols))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else. lower() is much faster and does the same unless another upper-case letter is there."""
    return F.when(c.rlike(OTHER_UPPER), F.translate(c, UPPER, LOWER)).otherwise(F.lower(c))


def item_words(text: Column) -> Column:
    """The ITEM_WORD words of a text, lower-cased, found by splitting at the other characters; the first and last element may be empty.

    Splitting is several times faster than extracting. The empty elements are no words: they match no term.
    """
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), ITEM_GAP, -1)


def item_word_count(text: Column) -> Column:
    """The number of words of item_words(), without lower-casing: A-Z are no gap here."""
    parts = F.split(F.coalesce(text, F.lit("")), CASED_GAP, -1)
    n = F.size(parts)
    return n - F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) - F.when((n > 1) & (F.get(parts, n - 1) == ""), 1).otherwise(0)


def text_hash(c: Column) -> Column:
    return F.xxhash64(c)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        steps = [np.full(size, b, dtype=_U) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for s in steps:
            s[0] = 1
        _powers[:] = [np.cumprod(s, dtype=_U) for s in steps]
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Weighted prefix sums: with powers() they give the hash of any span in O(1)."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end); equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space) of the texts, and where each text's words begin (n+1 offsets)."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    if lower:
        data = _LOWERED[data]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    bounds = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return span_hashes(prefix_sums(data), start, end), np.searchsorted(start, bounds)


def in_chunks(sizes: list[int], limit: int = CHUNK_BYTES):
    """Consecutive index ranges whose sizes sum to about limit at most (one item at least)."""
    lo = total = 0
    for i, s in enumerate(sizes):
        if i > lo and total + s > limit:
            yield lo, i
            lo, total = i, 0
        total += s
    if lo < len(sizes):
        yield lo, len(sizes)

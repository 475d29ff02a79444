"""Helpers that the text operators share: scratch tables, bound sub-expressions, byte views of Arrow text."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word contracts, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
NON_SPACE = r"[^\x20\x09-\x0D]"


#: Where the tables of stored() lie.
_STORED: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share. Where it is unset: a temporary one in local mode, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there and every executor sees it.

    batch_rows: rows of an Arrow batch during this write alone, for rows that hold megabytes each.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = scratch(spark, name), spark.conf.get(key)
    try:
        if batch_rows:
            spark.conf.set(key, str(batch_rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later step reads, so that they don't count against the folder until the run ends."""
    for df in tables:
        path = _STORED.pop(df, None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, although a lambda in body refers to it."""
    return F.transform(F.array(value), body)[0]


def text_of(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+", -1), "")


def release() -> None:
    """Gives freed memory back to the system; a worker process serves many tasks and would otherwise keep its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call outside glibc
        pass


def views(batch: pa.RecordBatch, column: str, limit: int = 2_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about `limit` bytes of text; null reads as empty."""
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    n = len(col)
    if n == 0:
        return
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, over unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random odd multiplier, its inverse modulo 2**64, and a random value for each byte.
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "n" not in _POW or len(_POW["n"]) < n:
        m = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for key, base in (("n", _P), ("inv", _P_INV)):
                x = np.full(m, base, np.uint64)
                x[0] = 1
                _POW[key] = np.multiply.accumulate(x)
    return _POW["n"][:n], _POW["inv"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with len(data)+1 entries: (h[j] - h[i]) * inverse power of i identifies data[i:j]."""
    p, _ = _powers(len(data))
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * p, out=h[1:])
    return h


def range_hash(h: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [i, j), equal for equal bytes of equal length wherever they lie."""
    _, inv = _powers(len(h))
    return mix((h[j] - h[i]) * inv[i] + (j - i).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def run_hash(h: np.ndarray, size: int) -> np.ndarray:
    """range_hash of all ranges of `size` bytes, in order."""
    _, inv = _powers(len(h))
    return mix((h[size:] - h[:-size]) * inv[: len(h) - size] + np.uint64(size * 0x632BE59BD9B4E019 % (1 << 64)))


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of bytes that isn't ASCII white space; runs never cross rows."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def bounds_of(solid: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of set bytes; runs never cross rows."""
    edge = np.zeros(len(solid) + 1, bool)
    edge[off] = True
    before, after = np.zeros(len(solid), bool), np.zeros(len(solid), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(off, start, "right") - 1

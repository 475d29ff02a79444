"""Periodic runs of words: recursive frequency splitting, then a lag scan of the segments that survive.

A run is a maximal stretch of words with smallest period q and length >= max(6, 4 q). Each of its words stands in it four
times at least, so a word that stands fewer times in its segment lies in no run of that segment and splits it. The parts
are split again by their own counts until nothing changes; only what is left is scanned lag by lag.

One row at a time and no shuffle: a text is a row, and the work on m surviving words is about m log m.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, release, text_of, views, word_bounds, words_of

MIN_LENGTH, MIN_EXPONENT = 6, 4
#: Lags up to this are compared word by word; beyond it only multiples of the lag are tested before a stretch is extended.
DENSE_LAGS = 16

RUN = "struct<start:long,length:long,period:long>"


def word_bytes(data: np.ndarray) -> np.ndarray:
    return ~((data == 32) | ((data >= 9) & (data <= 13)))


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes."""
    packed = data[word_bytes(data)]
    off = np.concatenate(([0], np.cumsum(end - start)))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(packed)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def surviving_segments(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the segments in which every word stands often enough for a run; segments that settle leave the recursion."""
    done: list[tuple[np.ndarray, np.ndarray]] = []
    width = int(ids.max(initial=0)) + 1
    while True:
        long = end - start >= MIN_LENGTH
        start, end = start[long], end[long]
        if not len(start):
            break
        size = end - start
        seg = np.repeat(np.arange(len(start)), size)
        pos = np.arange(len(seg)) + np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        _, place, count = np.unique(seg * width + ids[pos], return_inverse=True, return_counts=True)
        often = count[place] >= MIN_EXPONENT
        settled = np.bincount(seg[~often], minlength=len(start)) == 0
        done.append((start[settled], end[settled]))
        often &= ~settled[seg]
        first = often & ~np.concatenate(([False], often[:-1] & (seg[1:] == seg[:-1])))
        last = often & ~np.concatenate((often[1:] & (seg[1:] == seg[:-1]), [False]))
        start, end = pos[first], pos[last] + 1
    s = np.concatenate([x for x, _ in done]) if done else np.zeros(0, np.int64)
    e = np.concatenate([x for _, x in done]) if done else np.zeros(0, np.int64)
    return s, e


def _equal_ahead(w: np.ndarray, i: int, j: int) -> int:
    """How many words from i on equal those from j on, i < j; blocks double, so a long stretch takes few steps."""
    n, step = 0, 64
    while j + n < len(w):
        k = min(step, len(w) - j - n)
        differs = w[i + n : i + n + k] != w[j + n : j + n + k]
        at = int(differs.argmax())
        if differs[at]:
            return n + at
        n, step = n + k, step * 2
    return n


def lag_scan(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment. A stretch already found with a smaller period is the same run."""
    m, runs, bounds = len(w), [], set()
    back = w[::-1]
    owner = np.full(m, -1, np.int64)  # a run that holds the word

    def add(s: int, e: int, q: int) -> None:
        if e - s >= max(MIN_LENGTH, MIN_EXPONENT * q) and (s, e) not in bounds:
            bounds.add((s, e))
            free = owner[s:e]
            free[free < 0] = len(runs)
            runs.append((s, e - s, q))

    for q in range(1, m // MIN_EXPONENT + 1):
        if q <= DENSE_LAGS:
            same = np.zeros(m - q + 2, np.int8)
            same[1:-1] = w[:-q] == w[q:]
            edge = np.flatnonzero(same[1:] != same[:-1])
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                add(s, e + q, q)
            continue
        same = w[: m - q : q] == w[q::q]
        if len(same) < 3:
            continue
        tests = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])  # a run of length 4 q holds three in a row
        at = 0
        while at < len(tests):
            j = int(tests[at]) * q
            r = int(owner[j])
            if r >= 0 and q % runs[r][2] == 0 and runs[r][0] + runs[r][1] > j + q:
                e = runs[r][0] + runs[r][1] - q
            else:
                s, e = j - _equal_ahead(back, m - j - q, m - j), j + _equal_ahead(w, j, j + q)
                add(s, e + q, q)
            at = max(at + 1, int(np.searchsorted(tests, -(-e // q))))
    return runs


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs array of (start, length, period) by start and period, best run, collapsed text) for every row.

    Words are runs of bytes other than ASCII white space. `best` has the greatest length / period (ties: smallest start,
    then period), null without runs. `collapsed` holds the words, joined by one space, without those that any run
    contains after its first period. Null and empty texts have no words; texts of any length are read whole; repeated rows
    and ids each get their own row; an empty table gives an empty one; other columns aren't read, so names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, off in views(b, "_t"):
                start, end, row = word_bounds(data, off)
                words = np.searchsorted(row, np.arange(z - a + 1))
                found: dict[int, list[tuple[int, int, int]]] = {}
                ids = word_ids(data, start, end)
                segments = zip(*surviving_segments(ids, words[:-1], words[1:]), strict=True)
                for s, e in segments:
                    k = int(np.searchsorted(words, s, "right")) - 1
                    for x, n, q in lag_scan(ids[s:e]):
                        found.setdefault(k, []).append((int(s - words[k]) + x, n, q))
                spaced, shown = data.copy(), word_bytes(data)  # shown: bytes of words, and the first byte after each
                gap = end[end < len(data)]
                gap = gap[~np.isin(gap, off)]
                spaced[gap] = 32
                shown[gap] = True
                runs, best, texts = [], [], []
                for k in range(z - a):
                    rs = sorted(found.get(k, []), key=lambda r: (r[0], r[2]))
                    runs.append([dict(start=s, length=n, period=q) for s, n, q in rs])
                    top = max(rs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                    best.append(dict(start=top[0], length=top[1], period=top[2]) if top else None)
                    lo, hi = off[k], off[k + 1]
                    if rs:
                        kept = np.ones(words[k + 1] - words[k], bool)
                        for s, n, q in rs:
                            kept[s + q : s + n] = False
                        raw = data[lo:hi].tobytes()
                        at = np.flatnonzero(kept) + words[k]
                        texts.append(b" ".join([raw[x:y] for x, y in zip((start[at] - lo).tolist(), (end[at] - lo).tolist(), strict=True)]).decode())
                    else:
                        texts.append(spaced[lo:hi][shown[lo:hi]].tobytes().rstrip(b" ").decode())
                kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                cols = [pa.array(np.diff(words)), pa.array(runs, pa.list_(kind)), pa.array(best, kind), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(a, z - a), *cols], names=["_id", "n_words", "runs", "best", "collapsed"])
            release()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    return rows.mapInArrow(run, f"_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed string").withColumnRenamed("_id", id_col)


def repeat_words(doc_id: Column, text: Column) -> Column:
    """The text with a stretch of words repeated, for ids that the query's rule picks; other texts and texts without words as they are. A null id isn't picked."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def changed(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        index = F.transform(F.sequence(F.lit(0), n - 1), at)
        return F.when(n == 0, text).otherwise(F.array_join(F.transform(index, lambda i: F.get(w, i)), " "))

    return F.when(h % 10 == 0, let(words_of(text), changed)).otherwise(text)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Columns of the query op13."""
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    return found.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def runs_of_documents(docs: DataFrame) -> DataFrame:
    """The query op13: repeated stretches are put in, then found."""
    return digest(find_runs(docs.select("doc_id", repeat_words(F.col("doc_id"), text_of("text")).alias("text"))))

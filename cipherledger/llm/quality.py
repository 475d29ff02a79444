"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, prefix_hash, range_hash, stored, views, word_bounds

#: Names of the statistics, in the order of the vector.
NAMES = ("bytes", "words", "word_len", "upper", "digits", "exclaim", "pipes", "symbols", "stops", "commas", "lines", "high", "same_next", "distinct", "seen_pairs", "long_words")
#: Share of the pooled spherical and pooled full covariance in each class covariance.
SHRINK_SPHERE, SHRINK_POOL = 0.05, 0.10
#: Temper of the log-density difference: statistics aren't independent normal draws, so raw differences overstate.
TEMPER = 4.0
FOLDS = 5


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Transformed statistics of each row's text, from its bytes alone. Empty texts have them too."""
    n = len(off) - 1

    def total(mask: np.ndarray) -> np.ndarray:
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return (c[off[1:]] - c[off[:-1]]).astype(float)

    start, end, row = word_bounds(data, off)
    per_row = lambda mask=None: np.bincount(row if mask is None else row[mask], minlength=n).astype(float)
    words, size = per_row(), end - start
    h = range_hash(prefix_hash(data), start, end)
    key = mix(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    same = np.concatenate(([False], key[1:] == key[:-1])) if len(key) else np.zeros(0, bool)

    def repeats(k: np.ndarray, r: np.ndarray) -> np.ndarray:
        order = np.argsort(k, kind="stable")
        again = np.concatenate(([False], k[order][1:] == k[order][:-1])) if len(k) else np.zeros(0, bool)
        return np.bincount(r[order][again], minlength=n).astype(float)

    mate = row[1:] == row[:-1]
    pair = mix(key[:-1] + mix(key[1:]))[mate]
    of = np.zeros(256, np.uint8)
    for bit, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b"#*$%&<>", b".?", b",;:", b"\n")):
        of[list(chars)] = 1 << bit
    kind = of[data]
    kinds = [total(kind == 1 << bit) for bit in range(8)]
    high = total(data >= 0xC0)
    nbytes = np.diff(off).astype(float)
    letters = np.maximum(nbytes - words, 1)
    rate = lambda x, base: np.log((x + 0.5) / (base + 5.0))
    cols = [np.log1p(nbytes), np.log1p(words), np.log((nbytes + 5) / (words + 1))]
    cols += [rate(kinds[0], letters), rate(kinds[1], letters)]
    cols += [rate(kinds[k], words) for k in (2, 3, 4, 5, 6, 7)]
    cols += [rate(high, letters), rate(per_row(same), words), rate(words - repeats(key, row), words), rate(repeats(pair, row[1:][mate]), words), rate(per_row(size > 24), words)]
    return np.stack(cols, 1)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats array<double>) of every row, whole texts; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(data, off) for _, _, data, off in views(b, "_t")]
            if x:
                flat = np.concatenate(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * len(NAMES), pa.int32()), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("_id"), lists], names=["_id", "stats"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    return rows.mapInArrow(run, "_id long, stats array<double>").withColumnRenamed("_id", id_col)


@dataclass
class Discriminant:
    """Class means and Cholesky factors; `score` is the tempered posterior of class 1."""

    means: np.ndarray
    factors: np.ndarray
    prior: float
    temper: float = TEMPER

    @classmethod
    def from_moments(cls, n: np.ndarray, s: np.ndarray, ss: np.ndarray, sphere: float = SHRINK_SPHERE, pool: float = SHRINK_POOL) -> Discriminant:
        """From the count, sum and sum of outer products of each class. A class without rows takes the other's place with the pooled covariance."""
        d = s.shape[1]
        m = s / np.maximum(n, 1)[:, None]
        m[n == 0] = s.sum(0) / max(n.sum(), 1)
        cov = np.stack([ss[k] / max(n[k], 1) - np.outer(m[k], m[k]) if n[k] else np.zeros((d, d)) for k in (0, 1)])
        pooled = (cov * n[:, None, None]).sum(0) / max(n.sum(), 1) + 1e-6 * np.eye(d)
        factors = []
        for k in (0, 1):
            own = 1.0 if n[k] > d else 0.0
            c = own * (1 - pool) * cov[k] + (1 - own * (1 - pool)) * pooled
            factors.append(np.linalg.cholesky((1 - sphere) * c + sphere * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)))
        return cls(m, np.stack(factors), float(np.log((n[1] + 1) / (n[0] + 1))))

    def score(self, x: np.ndarray) -> np.ndarray:
        logs = []
        for k in (0, 1):
            z = np.linalg.solve(self.factors[k], (x - self.means[k]).T)
            logs.append(-0.5 * (z * z).sum(0) - np.log(np.diag(self.factors[k])).sum())
        t = np.clip((logs[1] - logs[0]) / self.temper + self.prior, -40, 40)
        return 1 / (1 + np.exp(-t))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant:
    """Moments of all labelled rows that train, summed on the executors; null labels don't count, a row with several labels counts with each."""
    held = F.crc32(F.col(id_col).cast("string")) % FOLDS == 0
    y = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col), F.col(label_col).cast("int").alias("_y"))
    rows = stats.join(y, id_col).filter(~held).select("_y", "stats")
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            x = b.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            y = b.column("_y").to_numpy()
            for k in (0, 1):
                z = x[y == k]
                n[k] += len(z)
                s[k] += z.sum(0)
                ss[k] += z.T @ z
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.concatenate(([n[k]], s[k], ss[k].ravel()))], pa.list_(pa.float64()))], names=["k", "m"])

    parts = rows.mapInArrow(run, "k long, m array<double>").select("k", F.posexplode("m").alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    m = np.zeros((2, 1 + d + d * d))
    for r in parts.collect():  # 2 x (1 + d + d*d) numbers
        m[r["k"], r["i"]] = r["v"]
    return Discriminant.from_moments(m[:, 0], m[:, 1 : 1 + d], m[:, 1 + d :].reshape(2, d, d))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of every row. Repeated rows each get a row; with no usable labels every score is the prior."""
    stats = stored(document_statistics(docs, id_col, text_col), "quality-stats")
    model = fit(stats, labels, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(model.score(x))], names=[id_col, "score"])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))
    scored = stats.mapInArrow(run, f"`{id_col}` long, score double")
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

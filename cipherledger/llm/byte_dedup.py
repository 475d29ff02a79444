"""Removal of byte strings that an earlier document has, by suffix arrays over the texts that can repeat.

Documents travel in packs: one row holds the ids and compressed bytes of a few megabytes of text, so every pass sees
the same packs whatever the partitioning. Four steps:

1. Each window of LENGTH bytes picks the Q-byte string in it with the least hash, its anchor. Windows that pick one
   anchor form a segment. A pack sends for each distinct segment the hashes of its anchor and of all its bytes and the
   least document, as blocks of numbers, to the bucket of the anchor.
2. A bucket tells each pack, for each segment, whether an earlier document has all of it (code 1), or whether other
   documents have the anchor in another segment (code 2), so that parts of the segment may repeat. Anchors with more
   different segments than one array holds get code 3 instead.
3. Segments of code 2 send their bytes to the bucket of the anchor; those of code 3 fall apart into their windows, which
   go to buckets by their own bytes, so a hot anchor spreads and equal windows still meet. Strings that share a window
   go into a suffix array (linear grouping), where neighbours that agree in LENGTH bytes give each window its least
   document.
4. A pack joins what it was told, marks covered bytes and gives a row per document.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, prefix_hash, range_hash, release, run_hash, stored
from .suffix_groups import suffix_array

LENGTH, Q = 50, 26
#: Text bytes of a pack, of a bucket, and of one suffix array.
PACK_BYTES, BUCKET_BYTES, ARRAY_BYTES = 1_000_000, 3_000_000, 200_000
#: Windows of a pack that are hashed at a time; longer texts are cut there, which only splits a segment.
CHUNK = 2_000_000
#: Packs of one Arrow batch to Python.
PACKS = 4
_PACK = "pack long, ids binary, lens binary, data binary, extra binary"
_NONE = -(1 << 63)


def _batch(names: list[str], cols: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(cols, names=names)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    held: list[tuple[int, bytes, str]] = []
    size = 0

    def send() -> pa.RecordBatch:
        body = b"".join(t for _, t, _ in held)
        key = int.from_bytes(hashlib.blake2b(body + str([d for d, _, _ in held]).encode() + np.random.default_rng().bytes(16), digest_size=8).digest(), "little") >> 1
        ids = np.array([d for d, _, _ in held], "<i8").tobytes()
        lens = np.array([len(t) for _, t, _ in held], "<i8").tobytes()
        extra = press.compress("\n".join(x for _, _, x in held).encode())
        return _batch(["pack", "ids", "lens", "data", "extra"], [pa.array([key]), pa.array([ids], pa.binary()), pa.array([lens], pa.binary()), pa.array([press.compress(body)], pa.binary()), pa.array([extra], pa.binary())])

    for b in batches:
        for d, t, x in zip(b.column("_id").to_pylist(), b.column("_t"), b.column("_x").to_pylist(), strict=True):
            held.append((_NONE if d is None else d, t.as_buffer().to_pybytes() if t.is_valid else b"", x))
            size += len(held[-1][1])
            if size >= PACK_BYTES or len(held) >= 20_000:
                yield send()
                held, size = [], 0
    if held:
        yield send()


class Pack:
    """A pack's texts and their segments: anchor hash, segment hash, first and last window, row; entries are the distinct (anchor, segment)."""

    def __init__(self, ids: bytes, lens: bytes, data: bytes, length: int, q: int) -> None:
        self.ids = np.frombuffer(ids, "<i8")
        self.off = np.concatenate(([0], np.cumsum(np.frombuffer(lens, "<i8"))))
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        self.length = length
        found = [self._segments(c, length, q) for c in range(0, len(self.data) - length + 1, CHUNK)]
        none = np.zeros(0, np.int64)
        self.lo, self.hi, self.row, anchor, seg = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none, none.view(np.uint64), none.view(np.uint64))
        doc = self.ids[self.row]
        order = np.argsort(anchor)
        a = anchor[order]
        same = np.concatenate((a[1:] == a[:-1], [False])) if len(a) else np.zeros(0, bool)
        tied = np.flatnonzero(same | np.concatenate(([False], same[:-1])) if len(a) else same)
        few = order[tied]  # only equal anchors need the other keys
        order[tied] = few[np.lexsort((doc[few], seg[few], anchor[few]))]
        a, s, d = anchor[order], seg[order], doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
        self.anchor, self.seg, self.least = a[new], s[new], d[new]
        self.more = np.maximum.reduceat(d, np.flatnonzero(new)) > self.least if len(d) else np.zeros(0, bool)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.first = order[new]

    def _segments(self, c: int, length: int, q: int) -> tuple[np.ndarray, ...]:
        """First and last window, row, anchor and hash of the segments of the windows that start in [c, c + CHUNK)."""
        data, w = self.data[c : c + CHUNK + length - 1], length - q + 1
        h = prefix_hash(data)
        bits = np.uint64(len(data).bit_length())
        m = ((run_hash(h, q) >> bits) << bits) | np.arange(len(data) - q + 1, dtype=np.uint64)
        span = 1
        while span * 2 <= w:
            m = np.minimum(m[: len(m) - span], m[span:])
            span *= 2
        if w > span:
            m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
        at = (m & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        start = np.arange(len(at))
        row = np.repeat(np.arange(len(self.ids)), np.diff(np.clip(self.off, c, c + len(at))))
        ok = np.flatnonzero(start + c + length <= self.off[row + 1])
        at, row = at[ok], row[ok]
        new = np.ones(len(ok), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | (ok[1:] != ok[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(ok))[: len(first)] - 1
        lo, hi, at = ok[first], ok[last], at[first]
        return lo + c, hi + c, row[first], range_hash(h, at, at + q), range_hash(h, lo, hi + length)

    def buckets(self, n: int) -> list[tuple[int, int, int]]:
        b = ((self.anchor >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(b, np.arange(n + 1))
        return [(k, int(x), int(y)) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if x < y]


def _open(row: dict, length: int, q: int) -> Pack:
    p = Pack(row["ids"], row["lens"], row["data"], length, q)
    release()
    return p


_SENT = "pack long, bucket int, anchors binary, segs binary, low binary, high binary, more binary"


def _send(length: int, q: int, n: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                p = _open(row, length, q)
                cuts = p.buckets(n)
                planes = p.least.astype("<i8").view("<u4").reshape(-1, 2)
                cols = [p.anchor.astype("<u4"), p.seg.astype("<u8"), planes[:, 0].copy(), planes[:, 1].copy(), p.more.astype(np.uint8)]
                yield _batch([c.split()[0] for c in _SENT.split(", ")], [pa.array([row["pack"]] * len(cuts), pa.int64()), pa.array([k for k, _, _ in cuts], pa.int32()), *[pa.array([c[x:y].tobytes() for _, x, y in cuts], pa.binary()) for c in cols]])

    return run


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start flags of runs of equal keys, and their positions."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new, np.flatnonzero(new)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of the entries of whole buckets, for each pack and bucket that has any."""
    where, cols = [], []
    for b in batches:
        for i in range(b.num_rows):
            r = [np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("anchors", "<u4"), ("segs", "<u8"), ("low", "<u4"), ("high", "<u4"), ("more", np.uint8))]
            bucket = b.column("bucket")[i].as_py()
            where.append((b.column("pack")[i].as_py(), bucket, len(r[0])))
            cols.append((np.full(len(r[0]), bucket, np.uint64) << np.uint64(32) | r[0], r[1], np.stack((r[2], r[3]), 1).copy().view("<i8").ravel(), r[4].astype(bool)))
    if not where:
        return
    a, s, d, more = (np.concatenate(x) for x in zip(*cols, strict=True))
    order = np.lexsort((s, a))
    a, s, d, more = a[order], s[order], d[order], more[order]
    new_s, at_s = _groups(a, s)
    new_a, at_a = _groups(a)
    in_s, in_a = np.cumsum(new_s) - 1, np.cumsum(new_a) - 1
    low = np.minimum.reduceat(d, at_s)[in_s]
    several = (np.minimum.reduceat(d, at_a) < np.maximum.reduceat(d, at_a)) | np.maximum.reduceat(more, at_a)
    kinds = np.add.reduceat(new_s.astype(np.int64), at_a)
    parts = np.where(kinds * LENGTH * 3 // 2 > ARRAY_BYTES, 3, 2)
    code = np.where(d > low, 1, np.where((several & (kinds > 1))[in_a], parts[in_a], 0)).astype(np.uint8)
    back = np.empty(len(order), np.uint8)
    back[order] = code
    del a, s, d, more, order, cols, in_s, in_a, new_s, new_a, low, code
    release()
    x = 0
    for pack, bucket, n in where:
        part = back[x : x + n]
        x += n
        if part.any():
            yield _batch(["pack", "bucket", "codes"], [pa.array([pack]), pa.array([bucket], pa.int32()), pa.array([part.tobytes()], pa.binary())])


def _codes(p: Pack, told: list[dict] | None, n: int) -> np.ndarray:
    out = np.zeros(len(p.anchor), np.uint8)
    by = {t["bucket"]: t["codes"] for t in told or ()}
    for k, x, y in p.buckets(n):
        if k in by:
            out[x:y] = np.frombuffer(by[k], np.uint8)
    return out


_TEXTS = "pack long, bucket int, anchors binary, docs binary, entries binary, places binary, lens binary, body binary"


def _texts(length: int, q: int, n: int):  # noqa: ANN202
    """Bytes of the segments of code 2 and of the windows of those of code 3; places count the windows of a segment before a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                p = _open(row, length, q)
                code = _codes(p, row["told"], n)
                whole, apart = np.flatnonzero(code == 2), np.flatnonzero(code == 3)
                if not len(whole) and not len(apart):
                    continue
                wins = p.hi[p.first[apart]] - p.lo[p.first[apart]] + 1
                place = np.arange(int(wins.sum())) - np.repeat(np.cumsum(wins) - wins, wins)
                start = np.repeat(p.lo[p.first[apart]], wins) + place
                pick = np.concatenate((whole, np.repeat(apart, wins)))
                a = np.concatenate((p.lo[p.first[whole]], start))
                e = np.concatenate((p.hi[p.first[whole]], start)) + length
                key = np.concatenate((p.anchor[whole], window_hash(p.data, start, length)))
                order = np.argsort(key, kind="stable")
                pick, a, e, key, place = pick[order], a[order], e[order], key[order], np.concatenate((np.zeros(len(whole), np.int64), place))[order]
                size = (e - a).astype(np.int64)
                at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                body, ends = p.data[at], np.concatenate(([0], np.cumsum(size)))
                bucket = ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
                cut = np.searchsorted(bucket, np.arange(n + 1))
                rows = [(k, x, y) for k, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if x < y]
                cols = [key.astype("<u8"), p.least[pick].astype("<i8"), pick.astype("<u4"), place.astype("<u2"), size.astype("<u2")]
                blobs = [pa.array([c[x:y].tobytes() for _, x, y in rows], pa.binary()) for c in cols]
                blobs.append(pa.array([body[ends[x] : ends[y]].tobytes() for _, x, y in rows], pa.binary()))
                yield _batch([c.split()[0] for c in _TEXTS.split(", ")], [pa.array([row["pack"]] * len(rows), pa.int64()), pa.array([k for k, _, _ in rows], pa.int32()), *blobs])

    return run


def window_hash(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows at `start`, some at a time."""
    out, k = [np.zeros(0, np.uint64)], np.arange(length)
    for x in range(0, len(start), 20_000):
        part = data[start[x : x + 20_000, None] + k].ravel()
        edge = np.arange(0, len(part) + 1, length)
        out.append(range_hash(prefix_hash(part), edge[:-1], edge[1:]))
    return np.concatenate(out)


def repeated_windows(strings: list[bytes], docs: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each string the least document of each window of `length` bytes, over all strings that hold the window. docs: each string's documents."""
    ends = np.cumsum([len(s) + 1 for s in strings])
    text = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    of = np.repeat(np.arange(len(strings)), [len(s) + 1 for s in strings])
    for s, e in zip(strings, ends, strict=True):
        text[e - 1 - len(s) : e - 1] = np.frombuffer(s, np.uint8).astype(np.int64) + 1
    sa = np.array(suffix_array(array("i", text.astype(np.int32).tobytes())), np.int64)
    sa = sa[sa + length <= ends[of[sa]] - 1]
    raw = np.concatenate((text, np.zeros(length, np.int64))).astype(np.uint16)
    same = np.zeros(len(sa), bool)
    step = 10_000
    for x in range(1, len(sa), step):
        i, j = sa[x - 1 : x - 1 + step], sa[x : x + step]
        i = i[: len(j)]
        k = np.arange(length)
        same[x : x + len(j)] = (raw[i[:, None] + k] == raw[j[:, None] + k]).all(1)
    least = np.array([d.min() for d in docs], np.int64)
    out = np.full(len(text), 0, np.int64)
    if len(sa):
        new = np.flatnonzero(~same)
        low = np.minimum.reduceat(least[of[sa]], new)
        out[sa] = low[np.cumsum(~same) - 1]
    return [out[e - 1 - len(s) : e - length] for s, e in zip(strings, ends, strict=True)]


def _masks(anchor: np.ndarray, doc: np.ndarray, size: np.ndarray, texts: list[np.ndarray], length: int) -> Iterator[tuple[int, bytes]]:
    """(index, mask of the windows that an earlier document has) of those strings that have any; strings of an anchor come together."""
    body, ends = np.concatenate(texts), np.cumsum(size)
    # Only windows whose hash occurs in two documents can repeat; the rest of a string needs no place in the array.
    h = prefix_hash(body)
    wins = size - length + 1
    own = np.repeat(np.arange(len(size)), wins)
    at = np.arange(int(wins.sum())) - np.repeat(np.cumsum(wins) - wins, wins)
    pos = (ends - size)[own] + at
    key = mix(range_hash(h, pos, pos + length) + anchor[own])
    order = np.argsort(key, kind="stable")
    new, first = _groups(key[order])
    d = doc[own][order]
    shared = np.empty(len(order), bool)
    shared[order] = (np.minimum.reduceat(d, first) < np.maximum.reduceat(d, first))[np.cumsum(new) - 1]
    hit = np.flatnonzero(shared)
    if not len(hit):
        return
    who, start = np.unique(own[hit], return_index=True)
    lo = at[hit[start]]
    hi = at[hit[np.append(start[1:], len(hit)) - 1]]
    del h, own, at, pos, key, order, d, new, shared, hit
    strings: dict[tuple[int, bytes], list[int]] = {}
    for k, (w, x, y) in enumerate(zip(who.tolist(), lo.tolist(), hi.tolist(), strict=True)):
        base = int(ends[w] - size[w])
        strings.setdefault((int(anchor[w]), body[base + x : base + y + length].tobytes()), []).append(k)
    todo = sorted(strings.items())
    least = repeated_windows([s for (_, s), _ in todo], [doc[who[m]] for _, m in todo], length)
    for low, (_, members) in zip(least, todo, strict=True):
        for k in members:
            w = int(who[k])
            full = np.zeros(int(wins[w]), np.uint8)
            full[lo[k] : lo[k] + len(low)] = low < doc[w]
            if full.any():
                yield w, full.tobytes()


def _resolve(length: int):  # noqa: ANN202
    """Masks of the windows that an earlier document has, for each pack; from whole buckets of segment texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, cols, bodies = [], [], []
        for b in batches:
            for i in range(b.num_rows):
                r = [np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("anchors", "<u8"), ("docs", "<i8"), ("entries", "<u4"), ("places", "<u2"), ("lens", "<u2"))]
                cols.append((np.full(len(r[0]), len(packs)), *r))
                packs.append(b.column("pack")[i].as_py())
                bodies.append(np.frombuffer(b.column("body")[i].as_buffer(), np.uint8))
        if not packs:
            return
        pack, anchor, doc, entry, place, size = (np.concatenate(x) for x in zip(*cols, strict=True))
        size = size.astype(np.int64)
        body = np.concatenate(bodies)
        cols.clear()
        bodies.clear()
        at = np.cumsum(size) - size
        masks: list[tuple[int, int, int, bytes]] = []
        order = np.argsort(anchor, kind="stable")
        _, edge = _groups(anchor[order])
        ends = np.cumsum(size[order])
        x = 0
        while x < len(order):  # whole anchors, about ARRAY_BYTES at a time
            y = int(np.searchsorted(ends, (ends[x - 1] if x else 0) + ARRAY_BYTES, "right"))
            y = int(np.append(edge, len(order))[np.searchsorted(edge, max(y, x + 1))])
            part = order[x:y]
            for k, mask in _masks(anchor[part], doc[part], size[part], [body[at[i] : at[i] + size[i]] for i in part.tolist()], length):
                masks.append((int(pack[part[k]]), int(entry[part[k]]), int(place[part[k]]), mask))
            x = y
            release()
        masks.sort()
        x = 0
        while x < len(masks):
            y = x
            while y < len(masks) and masks[y][0] == masks[x][0]:
                y += 1
            part = masks[x:y]
            blobs = [np.array([m[c] for m in part], t).tobytes() for c, t in ((1, "<u4"), (2, "<u2"))]
            blobs += [np.array([len(m[3]) for m in part], "<u2").tobytes(), b"".join(m[3] for m in part)]
            yield _batch(["pack", "entries", "places", "lens", "masks"], [pa.array([packs[part[0][0]]]), *[pa.array([x], pa.binary()) for x in blobs]])
            x = y

    return run


def _finish(length: int, q: int, n: int, with_text: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                p = _open(row, length, q)
                code = _codes(p, row["told"], n)
                doc = p.ids[p.row]
                whole = (code[p.entry] == 1) | (doc > p.least[p.entry])
                delta = np.zeros(len(p.data) + 1, np.int32)
                np.add.at(delta, p.lo[whole], 1)
                np.add.at(delta, p.hi[whole] + length, -1)
                masks: dict[int, np.ndarray] = {}
                for m in row["masks"] or ():
                    x = 0
                    raw = np.frombuffer(m["masks"], np.uint8)
                    told = [np.frombuffer(m[c], t).tolist() for c, t in (("entries", "<u4"), ("places", "<u2"), ("lens", "<u2"))]
                    for e, at, k in zip(*told, strict=True):
                        if e not in masks:
                            f = p.first[e]
                            masks[e] = np.zeros(int(p.hi[f] - p.lo[f]) + 1, np.uint8)
                        masks[e][at : at + k] |= raw[x : x + k]
                        x += k
                if masks:
                    for s in np.flatnonzero(np.isin(p.entry, np.fromiter(masks, np.int64)) & ~whole).tolist():
                        at = p.lo[s] + np.flatnonzero(masks[int(p.entry[s])])
                        np.add.at(delta, at, 1)
                        np.add.at(delta, at + length, -1)
                gone = np.cumsum(delta[:-1]) > 0
                extra = zstandard.ZstdDecompressor().decompress(row["extra"]).decode().split("\n")
                out: list[tuple] = []
                for k, (a, e) in enumerate(zip(p.off[:-1].tolist(), p.off[1:].tolist(), strict=True)):
                    g = gone[a:e]
                    removed = int(g.sum())
                    spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if removed else 0
                    kept = p.data[a:e][~g].tobytes() if removed else p.data[a:e].tobytes()
                    text = None
                    if with_text:
                        text = _whole_chars(p.data[a:e], g) if removed else kept.decode()
                    d = int(p.ids[k])
                    out.append((None if d == _NONE else d, e - a, removed, spans, hashlib.sha256(kept).hexdigest(), text, extra[k]))
                kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string()), ("carried", pa.string())] * with_text
                yield _batch([k for k, _ in kinds], [pa.array([r[j] for r in out], t) for j, (_, t) in enumerate(kinds)])

    return run


def _whole_chars(data: np.ndarray, gone: np.ndarray) -> str:
    """Text without the removed bytes; a character of which only some bytes are removed stays."""
    head = (data & 0xC0) != 0x80
    at = np.cumsum(head) - 1
    full = np.minimum.reduceat(gone, np.flatnonzero(head))[at]
    return data[~full].tobytes().decode()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text, carried]) of every row; whole texts, null counts as empty.

    A byte is removed if a string of `length` bytes that covers it also starts in a document with a smaller id. Rows
    that share an id don't remove each other's bytes; a null id is the smallest. Texts shorter than `length` stay
    whole; very long ones are hashed CHUNK windows at a time. An empty table gives an empty table; other columns aren't read,
    but those named in `carry` come along in the struct `carried` when texts are asked for.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_t"), (F.to_json(F.struct(*carry)) if carry else F.lit("")).alias("_x"))
    packs = stored(rows.mapInArrow(_packs, _PACK), "packs")
    total = rows.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    codes = packs.mapInArrow(_send(length, q, n), _SENT).repartition(n, "bucket").mapInArrow(_judge, "pack long, bucket int, codes binary")
    codes = stored(codes.groupBy("pack").agg(F.collect_list(F.struct("bucket", "codes")).alias("told")), "codes", PACKS)
    told = packs.join(codes, "pack", "left")
    texts = told.mapInArrow(_texts(length, q, n), _TEXTS).repartition(n, "bucket").mapInArrow(_resolve(length), "pack long, entries binary, places binary, lens binary, masks binary")
    masks = stored(texts.groupBy("pack").agg(F.collect_list(F.struct("entries", "places", "lens", "masks")).alias("masks")), "masks", PACKS)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string, carried string" if with_text else "")
    out = told.join(masks, "pack", "left").mapInArrow(_finish(length, q, n, with_text), schema).withColumnRenamed("doc_id", id_col)
    if with_text:
        kinds = docs.select(*carry).schema.simpleString() if carry else ""
        out = out.withColumn("carried", F.from_json("carried", kinds)) if carry else out.drop("carried")
    return out

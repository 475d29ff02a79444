"""N-gram Jaccard self-join by PartEnum signatures, and its components.

1. Shingle sets are hashed in one pass. Documents with equal sets form a class, known by the set's digest.
2. In a set with a partner at similarity t, at most 1 - t of its shingles miss from the partner, hence from all other
   classes. Counting classes per shingle on a fixed part of the shingle domain therefore proves most classes to have no
   partner. Counting runs on blocks of numbers: a block per task and bucket of shingles, then one per bucket and range
   of classes, so no row stands for a shingle or for a class of a bucket.
3. The others get PartEnum signatures: sizes fall into bands [l, l / t]; two sets of one band or of neighbouring bands
   differ in at most k = 2 r (1 - t) / (1 + t) shingles, r being the band's largest size. The domain is cut into n1
   parts of N2 cells, n1 = ceil((k + 1) / 2), so in one part at most one cell differs: every choice of N2 - 1
   cells of each part is a signature.
4. Each group of equal signatures is checked against its least member (a star), and the links found are closed to
   components. Only pairs of different components in one group are still open. Large groups are dealt anew by a second,
   independent set of signatures, which any linked pair shares too.
5. Pairs pass an exact bound by parity bitmaps and are then verified on the whole sets. Open groups carry bitmaps folded
   to 1024 bits, so the join itself tests the bound and only pairs that pass it become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, prefix_hash, range_hash, stored, views, word_bounds
from .components import components

#: Words of a shingle and the similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Cells of a part; one may differ.
N2 = 4
#: Share of the shingle domain, in percent, on which documents per shingle are counted.
COUNTED = 30
#: Pairs of different components from which a group is dealt anew by further signatures, and how often at most.
LARGE, DEALS = 5_000_000, 3
#: Text bytes for each counting bucket; entries that a task gathers before it sends them.
BUCKET_BYTES, SEND = 5_000_000, 1_000_000
#: Least 64-bit words of a parity bitmap; larger sets have four bits a shingle, rounded up to a power of two of words.
BITMAP = 16
_SALT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted by row and hash, and their rows. Only A-Z is lower-cased."""
    low = data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    start, end, row = word_bounds(low, off)
    w = range_hash(prefix_hash(low), start, end)
    n = max(len(w) - size + 1, 0)
    acc = np.zeros(n, np.uint64)
    for k in range(size):
        acc += w[k : n + k] * _SALT[k % len(_SALT)] + np.uint64(k // len(_SALT))
    ok = row[size - 1 :] == row[: n] if n else np.zeros(0, bool)
    h, r = mix(acc[ok]), row[:n][ok]
    count = np.bincount(row, minlength=len(off) - 1)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):  # the whole sequence is the one shingle
        first = np.searchsorted(row, short)
        one = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            there = count[short] > k
            one[there] += w[first[there] + k] * _SALT[k % len(_SALT)]
        one = mix(one + count[short].astype(np.uint64) * np.uint64(0x517CC1B727220A95))
        h, r = np.concatenate((h, one)), np.concatenate((r, short))
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[keep], r[keep]


def _sums(h: np.ndarray, r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two order-free 64-bit digests of each row's set."""
    size = np.bincount(r, minlength=n).astype(np.int64)
    ends = np.cumsum(size)
    out = []
    for salt in (np.uint64(1), np.uint64(0x5851F42D4C957F2D)):
        c = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + salt))))
        out.append((c[ends] - c[ends - size]).view(np.int64))
    return size, out[0], out[1]


_FIRST = "doc_id long, n_shingles long, s1 long, s2 long, bucket int, keys binary, low binary, high binary, multi binary"
_ALONE = "range int, sets binary, counts binary"


def _first_pass(n_buckets: int, size: int):  # noqa: ANN202
    """Sets' digests, and for each bucket of the counted part of the domain its shingles with their class."""

    def send(h: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(first)
        low = np.minimum.reduceat(d, at)
        multi = np.maximum.reduceat(d, at) != low
        h = h[at]
        b = ((h >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
        cut = np.searchsorted(b, np.arange(n_buckets + 1))
        rows = [(k, x, y) for k, x, y in zip(range(n_buckets), cut[:-1], cut[1:], strict=True) if x < y]
        key, planes = h.astype("<u4"), low.astype("<i8").view("<u4").reshape(-1, 2)
        lo, hi = np.ascontiguousarray(planes[:, 0]), np.ascontiguousarray(planes[:, 1])
        none = pa.nulls(len(rows), pa.int64())
        blobs = [pa.array([v[x:y].tobytes() for _, x, y in rows], pa.binary()) for v in (key, lo, hi, multi.astype(np.uint8))]
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array([k for k, _, _ in rows], pa.int32()), *blobs], names=[c.split()[0] for c in _FIRST.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for a, e, data, off in views(b, "_t"):
                h, r = shingle_sets(data, off, size)
                k, s1, s2 = _sums(h, r, e - a)
                none = [pa.nulls(e - a, t) for t in (pa.int32(), *[pa.binary()] * 4)]
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(a, e - a), pa.array(k), pa.array(s1), pa.array(s2), *none], names=[c.split()[0] for c in _FIRST.split(", ")])
                part = (h & np.uint64(0xFFFFFFFF)) * np.uint64(100) >> np.uint64(32) < COUNTED
                held.append((h[part], s1[r[part]]))
                n += int(part.sum())
                if n >= SEND:
                    yield send(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                    held, n = [], 0
        if n:
            yield send(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))

    return run


def _blocks(where: np.ndarray, n: int, sets: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(where, kind="stable")
    sets, counts = sets[order].astype("<i8"), counts[order].astype("<u4")
    cut = np.searchsorted(where[order], np.arange(n + 1))
    rows = [(k, x, y) for k, x, y in zip(range(n), cut[:-1], cut[1:], strict=True) if x < y]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows], pa.int32()), *[pa.array([c[x:y].tobytes() for _, x, y in rows], pa.binary()) for c in (sets, counts)]], names=["range", "sets", "counts"])


def _lonely(n_ranges: int):  # noqa: ANN202
    """From whole buckets the classes that alone have some of the shingles, and how many, as a block for each range of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for b in batches:
            for i in range(b.num_rows):
                k, lo, hi, m = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in (("keys", "<u4"), ("low", "<u4"), ("high", "<u4"), ("multi", np.uint8)))
                bucket = np.full(len(k), b.column("bucket")[i].as_py(), np.uint64)
                parts.append([(bucket << np.uint64(32)) | k, np.stack((lo, hi), 1).copy().view("<i8").ravel(), m])
        if parts:
            k, d, m = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(k, kind="stable")
            k, d, m = k[order], d[order], m[order]
            at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            low, high = np.minimum.reduceat(d, at), np.maximum.reduceat(d, at)
            alone = (low == high) & (np.maximum.reduceat(m, at) == 0)
            sets, n = np.unique(low[alone], return_counts=True)
            where = (mix(sets.view(np.uint64)) % np.uint64(n_ranges)).astype(np.int64)
            yield _blocks(where, n_ranges, sets, n)

    return run


def _second_half(n_ranges: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            mask = b.column("bucket").is_null()
            info = b.filter(mask).select(["doc_id", "n_shingles", "s1", "s2"])
            if info.num_rows:
                none = [pa.nulls(info.num_rows, t) for t in (pa.int32(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*info.columns, *none], names=[*info.schema.names, "range", "sets", "counts"])
            held.append(b.filter(pc.invert(mask)).select(["bucket", "keys", "low", "high", "multi"]))
        for x in _lonely(n_ranges)(iter(held)):
            none = [pa.nulls(x.num_rows, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*none, *x.columns], names=["doc_id", "n_shingles", "s1", "s2", *x.schema.names])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(s1, alone) from whole ranges, block by block."""
    sets, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(more: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        u, at = np.unique(np.concatenate((sets, *more)), return_inverse=True)
        return u, np.bincount(at, np.concatenate((counts, *n)), len(u)).astype(np.int64)

    held: list[np.ndarray] = []
    told: list[np.ndarray] = []
    size = 0
    for b in batches:
        for i in range(b.num_rows):
            held.append(np.frombuffer(b.column("sets")[i].as_buffer(), "<i8"))
            told.append(np.frombuffer(b.column("counts")[i].as_buffer(), "<u4"))
            size += len(held[-1])
            if size >= SEND:
                sets, counts = add(held, told)
                held, told, size = [], [], 0
    sets, counts = add(held, told)
    yield pa.RecordBatch.from_arrays([pa.array(sets), pa.array(counts)], names=["s1", "alone"])


def band_starts(percent: int, upto: int) -> np.ndarray:
    """Least size of each band; a band reaches to the largest size that its least size can link to."""
    out = [1]
    while out[-1] <= upto:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, np.int64)


def signatures(flat: np.ndarray, sizes: np.ndarray, percent: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of sets (flat hashes, sizes): signature and set index. A set signs in its own band and the next."""
    starts = band_starts(percent, int(sizes.max(initial=1)) * 2)
    own = np.repeat(np.arange(len(sizes)), sizes)
    sig, who = [], []
    for step in (0, 1):
        band = np.searchsorted(starts, sizes, "right") - 1 + step
        k = 2 * (starts[band + 1] - 1) * (100 - percent) // (100 + percent)
        n1 = (k + 2) // 2
        cells = n1 * N2
        base = mix(flat + (band[own].astype(np.uint64) + np.uint64(seed * 1000 + 1)) * np.uint64(0x9E3779B97F4A7C15))
        cell = ((base >> np.uint64(32)) * cells[own].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        at = np.cumsum(cells) - cells
        sums = np.zeros(int(cells.sum()), np.uint64)
        np.add.at(sums, at[own] + cell, mix(base + np.uint64(7)))
        grid = sums.reshape(-1, N2)
        chosen = grid.sum(1, dtype=np.uint64)[:, None] - grid
        doc = np.repeat(np.arange(len(sizes)), n1)
        part = np.arange(len(doc)) - np.repeat(np.cumsum(n1) - n1, n1)
        salt = mix((band[doc].astype(np.uint64) << np.uint64(40)) + (part.astype(np.uint64) << np.uint64(8)) + np.uint64(seed))
        sig.append(mix(chosen + mix(salt[:, None] + np.arange(N2, dtype=np.uint64))).ravel())
        who.append(np.repeat(doc, N2))
    return np.concatenate(sig), np.concatenate(who)


def _lists(b: pa.RecordBatch, col: str) -> tuple[np.ndarray, np.ndarray]:
    lists = b.column(col)
    off = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy().view(np.uint64), np.diff(off)


def _pieces(sizes: np.ndarray, limit: int = 400_000) -> Iterator[tuple[int, int]]:
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, "right")))
        yield a, b
        a = b


def _sign(percent: int, seed: int, keep: list[str]):  # noqa: ANN202
    """Rows (sig, *keep) for each signature of each row's set; an old `sig` among the columns is mixed in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, sizes = _lists(b, "hashes")
            for x, y in _pieces(sizes):
                part = b.slice(x, y - x)
                flat, size = _lists(part, "hashes")
                sig, who = signatures(flat, size, percent, seed)
                if "sig" in part.schema.names:
                    sig = mix(sig + mix(part.column("sig").to_numpy().view(np.uint64))[who])
                idx = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), *[part.column(c).take(idx) for c in keep]], names=["sig", *keep])

    return run


def _second_pass(size: int):  # noqa: ANN202
    """Whole sets and their bitmaps for the classes that are left, from a text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s1, s2 = b.column("_s1").to_numpy(), b.column("_s2").to_numpy()
            for a, e, data, off in views(b, "_t"):
                h, r = shingle_sets(data, off, size)
                n, t1, t2 = _sums(h, r, e - a)
                words = np.maximum(BITMAP, 1 << np.ceil(np.log2(np.maximum(n, 1) / 16)).clip(0).astype(np.int64))
                ends = np.cumsum(words)
                x = mix(h + np.uint64(99))
                bits = np.zeros(int(ends[-1]), np.uint64)
                np.bitwise_xor.at(bits, (ends - words)[r] + (x & (words[r] - 1).astype(np.uint64)).astype(np.int64), np.uint64(1) << (x >> np.uint64(58)))
                off32 = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(off32), pa.array(h.view(np.int64)))
                maps = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(bits.view(np.int64)))
                same = pa.array(np.flatnonzero((t1 == s1[a:e]) & (t2 == s2[a:e])))
                out = pa.RecordBatch.from_arrays([pa.array(t1), pa.array(n), sets, maps], names=["rep", "n", "hashes", "bits"])
                yield out.take(same)

    return run


def _differ(words: list[tuple[Column, Column]], na: Column, nb: Column, percent: int) -> Column:
    """False only if more bits differ than two sets of these sizes that link can have differing shingles."""
    differ = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in words[1:]), F.bit_count(words[0][0].bitwiseXOR(words[0][1])))
    return differ * (100 + percent) <= (na + nb) * (100 - percent)


def _sketches(sets: DataFrame) -> DataFrame:
    """(rep, b0 .. b15): bitmaps folded to 16 words; folding keeps the bound, as it only cancels bits."""
    zero = F.lit(0).cast("long")
    fold = lambda k: F.aggregate(F.sequence(F.lit(k), F.size("bits") - 1, F.lit(BITMAP)), zero, lambda acc, i: acc.bitwiseXOR(F.get("bits", i)))
    return sets.select("rep", *[fold(k).alias(f"b{k}") for k in range(BITMAP)])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough: sizes and bitmaps bound the difference, whole sets decide."""
    small = sets.select("rep", "n", "bits")
    side = lambda k: small.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"m{k}"))
    near = pairs.join(side("a"), "a").filter("a IS NOT NULL").join(side("b"), "b")
    near = near.filter((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent))
    length = F.least(F.size("ma"), F.size("mb"))  # sizes that can link have equal lengths or one twice the other
    fold = lambda m: F.when(F.size(m) > length, F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.get(m, i).bitwiseXOR(F.get(m, i + length)))).otherwise(F.col(m))
    near = near.withColumns({"ma": fold("ma"), "mb": fold("mb")})
    differ = F.aggregate(F.arrays_zip("ma", "mb"), F.lit(0), lambda acc, z: acc + F.bit_count(z["ma"].bitwiseXOR(z["mb"])))
    near = near.filter(differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b", "na", "nb")
    full = lambda k: sets.select(F.col("rep").alias(k), F.col("hashes").alias(f"h{k}"))
    both = F.size(F.array_intersect("ha", "hb")).cast("long")
    checked = near.join(full("a"), "a").join(full("b"), "b")
    return checked.filter(both * 100 >= (F.col("na") + F.col("nb") - both) * percent).select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, component_id, n_class) for every row; two documents link at `percent` similarity or more.

    Texts without words (null, empty) have no shingles, link with nothing and are their own component. Very long texts
    are hashed whole, one at a time. Rows that share an id are one document to the links, so texts linked with any of
    them meet in one component; a null id gets a null component. Equal sets are one class, known by two 64-bit digests:
    n_class counts its rows. An empty table gives an empty table; other columns aren't read, whatever their names. Sets
    are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    total = rows.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    n_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(n_ranges, -(-total // BUCKET_BYTES))
    first = rows.mapInArrow(_first_pass(n_buckets, size), _FIRST)
    # Documents' own rows come along with the blocks; copies and null ids spread.
    deal = F.coalesce(F.col("bucket"), F.pmod(F.xxhash64("doc_id", "s1", "n_shingles"), F.lit(n_buckets)).cast("int"))
    told = stored(first.repartition(n_buckets, deal).mapInArrow(_second_half(n_ranges), f"doc_id long, n_shingles long, s1 long, s2 long, {_ALONE}"), "shingle-counts")
    info = told.filter("range IS NULL").select("doc_id", "n_shingles", "s1", "s2")
    blocks = told.filter("range IS NOT NULL").select("range", "sets", "counts")
    alone = blocks.repartition(n_ranges, "range").mapInArrow(_summed, "s1 long, alone long")
    full = info.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = full.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_class"), F.first("n_shingles").alias("n"))
    classes = stored(classes.join(alone, "s1", "left"), "shingle-classes")
    left = classes.filter(F.coalesce("alone", F.lit(0)) * 100 <= F.col("n") * (100 - percent))
    todo = rows.join(left.select(F.col("rep").alias("_id"), F.col("s1").alias("_s1"), F.col("s2").alias("_s2")), "_id")
    sets = todo.mapInArrow(_second_pass(size), "rep long, n long, hashes array<long>, bits array<long>")
    sets = stored(sets.dropDuplicates(["rep"]), "shingle-sets")
    links = _links(sets, percent)
    discard(sets)
    several = full.groupBy("doc_id").agg(F.min("s1").alias("a"), F.max("s1").alias("_m")).filter("a <> _m").select("doc_id", "a")
    links = links.union(full.join(several, "doc_id").filter("s1 <> a").select("a", F.col("s1").alias("b")))
    label = components(links).withColumnRenamed("node", "s1")
    least = label.join(classes.select("s1", "rep"), "s1").groupBy("component").agg(F.min("rep").alias("least"))
    label = label.join(least, "component").select("s1", "least")
    out = info.join(classes.select("s1", "s2", "rep", "n_class"), ["s1", "s2"], "left").join(label, "s1", "left")
    known = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("least", "rep")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", known.alias("component_id"), F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("n_class")).otherwise(F.lit(1).cast("long")).alias("n_class"))
    return out.withColumnRenamed("doc_id", id_col)


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """All links between classes that components need, as verified pairs (a, b)."""
    sig = stored(sets.select("rep", "n", "hashes").mapInArrow(_sign(percent, 0, ["rep", "n"]), "sig long, rep long, n long"), "signatures")
    star = stored(_star(sig), "stars")
    links = stored(_linked(star, sets, percent), "star-links")
    label = components(links).withColumnRenamed("node", "rep")
    open_ = stored(_mixed(sig, label), "open-groups")
    sketches = stored(_sketches(sets), "sketches")
    discard(sig, star)
    found, used = [links], [links, open_, sketches]
    for deal in range(1, DEALS + 1):
        few = open_.filter(F.col("c") <= LARGE) if deal < DEALS else open_
        found.append(_linked(_cross(few.join(sketches, "rep"), percent), sets, percent))
        if deal == DEALS:
            break
        many = open_.filter(F.col("c") > LARGE)
        if many.isEmpty():
            break
        again = many.select("sig", "rep").join(sets.select("rep", "n", "hashes"), "rep").mapInArrow(_sign(percent, deal, ["rep", "n"]), "sig long, rep long, n long")
        open_ = stored(_mixed(again, label), "open-groups")
        used.append(open_)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    out = stored(out.distinct(), "links")
    discard(*used)
    return out


def _star(sig: DataFrame) -> DataFrame:
    heads = sig.groupBy("sig").agg(F.min("rep").alias("a"), F.count("*").alias("c")).filter("c > 1").select("sig", "a")
    return sig.join(heads, "sig").filter("rep <> a").select("a", F.col("rep").alias("b")).distinct()


def _mixed(sig: DataFrame, label: DataFrame) -> DataFrame:
    """Members (sig, rep, n, comp) of the groups that still hold several components, with the group's pairs of different components c."""
    x = sig.join(label, "rep", "left").select("sig", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    sizes = x.groupBy("sig", "comp").agg(F.count("*").alias("k"))
    groups = sizes.groupBy("sig").agg(F.count("*").alias("several"), F.sum("k").alias("all"), F.sum(F.col("k") * F.col("k")).alias("own"))
    groups = groups.filter("several > 1").select("sig", ((F.col("all") * F.col("all") - F.col("own")) / 2).alias("c"))
    return x.join(groups, "sig")


def _cross(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of one group whose components differ and whose sizes and folded bitmaps allow a link."""
    words = range(BITMAP)
    x = members.select("sig", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), *[F.col(f"b{k}").alias(f"x{k}") for k in words])
    y = members.select(F.col("sig").alias("sig_b"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), *[F.col(f"b{k}").alias(f"y{k}") for k in words])
    fits = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    fits = fits & _differ([(F.col(f"x{k}"), F.col(f"y{k}")) for k in words], F.col("na"), F.col("nb"), percent)
    return x.join(y, (F.col("sig") == F.col("sig_b")) & fits).select("a", "b").distinct()

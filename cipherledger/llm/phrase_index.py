"""Phrase collocations: an FM-index per shard over word ids, extended in both directions, with counts summed across shards.

A shard is about a million words of one language. Level by level, each shard extends the intervals of the phrases that are
frequent over all shards: to the left through the index of its words, to the right through the index of its words in
reverse, keeping both intervals in step. A phrase of d + 1 words is reported where it came up both ways, that is with its
first d and its last d words frequent. It is known by those two phrases' numbers, so keys are exact.
Spark sums the counts, numbers what is frequent and hands each shard its own intervals of those for the next level.
Phrases that are frequent nowhere in part are never enumerated, and none that is frequent is lost. Counts travel in
blocks, one for each shard and bucket of keys that has any, so there are never more blocks than counts; buckets grow in
number with the words, so the work on one stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounds_of, discard, mix, prefix_hash, range_hash, release, stored, views

#: Words after which a shard is closed; a text is never cut, so a shard can be longer by one text.
SHARD_WORDS = 1 << 20
#: Words to a bucket, where counts of shards are summed, and the fewest buckets.
BUCKET_WORDS, MIN_BUCKETS = 1 << 20, 64
#: Bytes that end a piece, and those that stand between words.
MARKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"


def _order(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """Indices by (high, low), equal ones in order."""
    if 3 * bits <= 63:
        key = (high << (2 * bits)) | (low << bits) | np.arange(len(high))
        key.sort()
        return key & ((1 << bits) - 1)
    return np.lexsort((low, high))


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate((x[k:], np.zeros(min(k, len(x)), x.dtype)))


def suffix_order(codes: np.ndarray, depth: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first `depth` words, and for each row the first row that has the same ones."""
    ranks, have = {1: codes}, 1
    high, low = codes, np.zeros_like(codes)
    while True:
        order = _order(high, low, bits)
        h, w = high[order], low[order]
        fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
        if have == depth:
            return order, np.maximum.accumulate(np.where(fresh, np.arange(len(codes)), 0))
        if have > 1:
            ranks[have] = np.empty_like(codes)
            ranks[have][order] = np.cumsum(fresh)
        step = min(have, depth - have)
        high, low = ranks[have], _ahead(ranks[step], have)
        have += step


def _extensions(before: np.ndarray, lo: np.ndarray, cnt: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """(interval, count, first row, rows of smaller words) for each word that stands before the rows of each interval; mark 0 is no word."""
    t = np.repeat(np.arange(len(lo)), cnt)
    start = np.cumsum(cnt) - cnt
    row = np.arange(len(t)) + np.repeat(lo - start, cnt)
    if 3 * bits <= 63:
        key = (t << (2 * bits)) | (before[row] << bits) | row
        key.sort()
        t, word, row = key >> (2 * bits), (key >> bits) & ((1 << bits) - 1), key & ((1 << bits) - 1)
    else:
        o = np.lexsort((row, before[row], t))
        t, word, row = t[o], before[row][o], row[o]
    first = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (word[1:] != word[:-1])))) if len(t) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(t)))
    t, word, row = t[first], word[first], row[first]
    smaller = first - start[t]
    real = word > 0
    return t[real], size[real], row[real], smaller[real]


def extend(codes: np.ndarray, depth: int, lo: np.ndarray) -> tuple[np.ndarray, ...]:
    """(index of the first words' phrase, of the last words' phrase, count, first row) of all phrases of depth + 1 words whose first and last `depth` words are among those whose first rows are lo.

    codes: words from 1 on, marks 0, with a mark at both ends. Rows are in the order of suffixes.
    """
    n = len(codes)
    bits = int(max(n, codes.max(initial=0) + 1)).bit_length()
    order, head = suffix_order(codes, depth, bits)
    back = codes[::-1]
    back_order, back_head = suffix_order(back, depth, bits)
    heads = np.flatnonzero(head == np.arange(n))
    cnt = np.diff(np.append(heads, n))[np.searchsorted(heads, lo)]
    row_of = np.empty(n, np.int64)
    row_of[back_order] = np.arange(n)
    lo_back = back_head[row_of[n - depth - order[lo]]]  # the same interval among the reversed words
    before = codes[order - 1]
    lf = np.empty(n, np.int64)
    lf[_order(before, np.zeros_like(before), bits)] = np.arange(n)
    last, size, row, _ = _extensions(before, lo, cnt, bits)
    first, _, _, smaller = _extensions(back[back_order - 1], lo_back, cnt, bits)
    # To the left rows follow from the index itself; to the right the interval moves on by the smaller words beside it.
    both, a, b = np.intersect1d(lf[row], lo[first] + smaller, assume_unique=True, return_indices=True)
    return first[b], last[a], size[a], both


def _packed(x: np.ndarray) -> bytes:
    planes = x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return pa.Codec("zstd").compress(planes, asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = pa.Codec("zstd").decompress(raw, 8 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<i8").ravel()


SHARD = "shard long, lang string, n_words long, n_codes long, codes binary, words array<string>, counts array<long>, rows array<long>"


def word_shards(docs: DataFrame) -> DataFrame:
    """A row for each shard: its codes, and its words with counts and first rows by code, as words lie in the order of codes after all marks. Columns of docs: _lang, _t.

    Shards follow the partitions of docs, so they are numbered by partition; the table is stored before it is used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[str, list[tuple[pa.Array, np.ndarray]]] = {}
        size: dict[str, int] = {}
        is_mark, is_word = np.zeros(256, bool), np.ones(256, bool)
        is_mark[list(MARKS)] = True
        is_word[list(MARKS + BLANKS)] = False

        def shard(lang: str) -> pa.RecordBatch:
            nonlocal made
            size.pop(lang)
            parts = held.pop(lang)
            found = pa.concat_arrays([x for x, _ in parts]).dictionary_encode()
            ids, fresh = found.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, np.concatenate([x for _, x in parts])
            codes = np.zeros(len(ids) + int(fresh.sum()) + 1, np.int64)
            codes[np.arange(len(ids)) + np.cumsum(fresh)] = ids
            counts = np.bincount(ids - 1, minlength=len(found.dictionary))
            made += 1
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            cols = [pa.array([(part << 24) + made]), pa.array([lang]), pa.array([len(ids)]), pa.array([len(codes)]), pa.array([_packed(codes)])]
            return pa.RecordBatch.from_arrays([*cols, one(found.dictionary.cast(pa.large_string()).cast(pa.string())), one(pa.array(counts)), one(pa.array(len(codes) - len(ids) + np.cumsum(counts) - counts))], names=["shard", "lang", "n_words", "n_codes", "codes", "words", "counts", "rows"])

        for b in batches:
            langs = b.column("_lang").dictionary_encode()
            names, of = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            for a, _, data, off in views(b, "_t"):
                data = data + 32 * ((data >= 65) & (data <= 90)).astype(np.uint8)
                solid = is_word[data]
                start, end, row = bounds_of(solid, off)
                if not len(start):
                    continue
                marks = np.concatenate(([0], np.cumsum(is_mark[data])))
                fresh = np.concatenate(([True], (row[1:] != row[:-1]) | (marks[start[1:]] > marks[end[:-1]])))
                words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(end - start)))), pa.py_buffer(data[solid])])
                lang = of[row + a]
                for k in np.unique(lang).tolist():
                    at = np.flatnonzero(lang == k)
                    held.setdefault(names[k], []).append((words.take(pa.array(at)), fresh[at]))
                    size[names[k]] = size.get(names[k], 0) + len(at)
                    if size[names[k]] >= SHARD_WORDS:
                        yield shard(names[k])
            if sum(size.values()) > 4 * SHARD_WORDS:  # many languages at once: memory stays bounded
                yield shard(max(size, key=lambda x: size[x]))
        for name in list(held):
            yield shard(name)
        release()

    return docs.mapInArrow(run, SHARD)


#: A block of what one shard has found for one bucket; the columns pgid to rows are packed numbers, in level 1 words stand for ids.
BLOCK = "bucket long, shard long, n long, pgid binary, sgid binary, counts binary, rows binary"
WORD_BLOCK = "bucket long, shard long, lang string, words array<string>, counts array<long>, rows array<long>"
#: Answers to a shard (shard, gid, lo), and what is frequent in a bucket (shard null).
ANSWER = "shard long, gid array<long>, lo array<long>, lang array<string>, word array<string>, pgid array<long>, sgid array<long>, f array<long>"


def _lists(cut: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), values)


def _word_blocks(shards: DataFrame, buckets: int) -> DataFrame:
    """Each shard's words, dealt to buckets by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words = b.column("words")[i].values
                raw = words.cast(pa.large_string()).cast(pa.large_binary())
                off = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)
                data = np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]]
                h = range_hash(prefix_hash(data), off[:-1] - off[0], off[1:] - off[0]) % np.uint64(buckets)
                order = np.argsort(h, kind="stable")
                own, at = np.unique(h[order], return_index=True)
                cut, take = np.append(at, len(h)), pa.array(order)
                cols = [pa.array(own.astype(np.int64)), pa.array([b.column("shard")[i].as_py()] * len(own)), pa.array([b.column("lang")[i].as_py()] * len(own))]
                yield pa.RecordBatch.from_arrays([*cols, *[_lists(cut, b.column(c)[i].values.take(take)) for c in ("words", "counts", "rows")]], names=["bucket", "shard", "lang", "words", "counts", "rows"])

    return shards.select("shard", "lang", "words", "counts", "rows").mapInArrow(run, WORD_BLOCK)


def _answers(bucket: int, shard: np.ndarray, cut: np.ndarray, key: np.ndarray, lo: np.ndarray, often: np.ndarray, known: dict[str, pa.Array]) -> pa.Table:
    """Rows of ANSWER. shard, cut: the blocks; key: a number for each of their entries; often: keys that are frequent; known: their columns."""
    gid = np.full(len(often), -1, np.int64)
    gid[often] = (bucket << 32) + np.arange(int(often.sum()))
    mine = gid[key]
    hit = mine >= 0
    kept = np.concatenate(([0], np.cumsum(hit)))[cut]
    got = np.flatnonzero(np.diff(kept))
    at = np.append(kept[:-1][got], kept[-1])
    one, none = np.array([0, int(often.sum())]), lambda kind, n: pa.nulls(n, pa.list_(kind))
    kinds = {f.name: f.type.value_type for f in ANSWER_TYPES if f.name != "shard"}
    told = {"gid": _lists(at, pa.array(mine[hit])), "lo": _lists(at, pa.array(lo[hit]))}
    rows = [[pa.array(shard[got])] + [told.get(c, none(k, len(got))) for c, k in kinds.items()]]
    known = known | {"gid": pa.array(gid[often])}
    rows.append([pa.nulls(1, pa.int64())] + [_lists(one, known[c]) if c in known else none(k, 1) for c, k in kinds.items()])
    return pa.concat_tables([pa.table(r, schema=ANSWER_TYPES) for r in rows])


ANSWER_TYPES = pa.schema(
    [("shard", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("gid", "lo")], *[(c, pa.list_(pa.string())) for c in ("lang", "word")], *[(c, pa.list_(pa.int64())) for c in ("pgid", "sgid", "f")]]
)


def _frequent_words(blocks: DataFrame, min_count: int) -> DataFrame:
    """Sums over the shards of one bucket's words; numbers the frequent ones and tells each shard its own."""

    def run(t: pa.Table) -> pa.Table:
        flat = lambda c: t[c].combine_chunks().flatten()
        size = np.array([len(x) for x in t["words"]])
        cut = np.concatenate(([0], np.cumsum(size)))
        langs = t["lang"].combine_chunks().take(pa.array(np.repeat(np.arange(t.num_rows), size)))
        words = flat("words")
        # A word has no blank in it, so the last one tells the language from it.
        keys = pc.binary_join_element_wise(langs.cast(pa.large_string()), words.cast(pa.large_string()), pa.scalar(" ", pa.large_string())).dictionary_encode()
        key = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        f = np.zeros(len(keys.dictionary), np.int64)
        np.add.at(f, key, flat("counts").to_numpy(zero_copy_only=False))
        often = f >= min_count
        _, some = np.unique(key, return_index=True)
        show = pa.array(some[often])
        return _answers(t["bucket"][0].as_py(), t["shard"].to_numpy(), cut, key, flat("rows").to_numpy(zero_copy_only=False), often, {"lang": langs.take(show), "word": words.take(show), "f": pa.array(f[often])})

    return blocks.groupBy("bucket").applyInArrow(run, ANSWER)


def _blocks(shards: DataFrame, frequent: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Phrases of depth + 1 words in each shard, dealt to buckets by their key. frequent: answers about phrases of `depth` words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["bucket", "shard", "n", "pgid", "sgid", "counts", "rows"]
        out: list[list] = [[] for _ in names]
        if left.num_rows and right.num_rows:
            home = left["home"][0].as_py()
            gid, lo = (right[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("gid", "lo"))
            first, last, size, rows = extend(_unpacked(left["codes"][0].as_py(), left["n_codes"][0].as_py()), depth, lo)
            pgid, sgid = gid[first], gid[last]
            bucket = (_key_hash(pgid, sgid) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            own, at = np.unique(bucket[order], return_index=True)
            for k, ix in zip(own.tolist(), np.split(order, at[1:]), strict=True) if len(own) else []:
                for col, x in zip(out, (k, home, len(ix), _packed(pgid[ix]), _packed(sgid[ix]), _packed(size[ix]), _packed(rows[ix])), strict=True):
                    col.append(x)
        release()
        return pa.table([pa.array(x, pa.int64() if i < 3 else pa.binary()) for i, x in enumerate(out)], names=names)

    codes = shards.select(F.col("shard").alias("home"), "n_codes", "codes")
    return codes.groupBy("home").cogroup(frequent.groupBy("shard")).applyInArrow(run, BLOCK)


def _key_hash(pgid: np.ndarray, sgid: np.ndarray) -> np.ndarray:
    return mix(mix(pgid.view(np.uint64)) + sgid.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _frequent_phrases(blocks: DataFrame, min_count: int) -> DataFrame:
    """As _frequent_words, of phrases known by their first and last words' phrases."""

    def run(t: pa.Table) -> pa.Table:
        size = t["n"].to_numpy()
        pgid, sgid, cnt, lo = (np.concatenate([_unpacked(x.as_py(), n) for x, n in zip(t[c], size.tolist(), strict=True)]) for c in ("pgid", "sgid", "counts", "rows"))
        h = _key_hash(pgid, sgid)
        order = np.argsort(h)
        x, p, s = h[order], pgid[order], sgid[order]
        other = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
        if (other & (x[1:] == x[:-1])).any():  # two keys with one hash: sort by the keys themselves
            order = np.lexsort((sgid, pgid))
            p, s = pgid[order], sgid[order]
            other = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
        head = np.concatenate(([True], other))
        at = np.flatnonzero(head)
        f = np.add.reduceat(cnt[order], at)
        key = np.empty(len(order), np.int64)
        key[order] = np.cumsum(head) - 1
        often = f >= min_count
        return _answers(t["bucket"][0].as_py(), t["shard"].to_numpy(), np.concatenate(([0], np.cumsum(size))), key, lo, often, {"pgid": pa.array(p[at][often]), "sgid": pa.array(s[at][often]), "f": pa.array(f[often])})

    return blocks.groupBy("bucket").applyInArrow(run, ANSWER)


def _known(answers: DataFrame, *columns: str) -> DataFrame:
    """A row for each frequent word or phrase."""
    return answers.filter("shard is null").select(F.inline(F.arrays_zip("gid", "f", *columns)))


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 100, max_words: int = 5) -> DataFrame:
    """(lang, phrase, words, a, l, r, cut, n, score, dropped) of all phrases of 2 to max_words words that stand min_count times in their language.

    n: words of the language; a, l, r: counts of the phrase and of its parts at the lowest-scoring cut (ties: the earliest);
    dropped: a phrase one word longer, and as frequent, holds it. A null language is `und`; null and empty texts have no
    words; repeated rows count each time; other columns aren't read, so names can't clash; an empty table gives an empty
    one. Texts are read whole and never cut.
    """
    lang, text = F.coalesce(F.col(lang_col), F.lit("und")), F.coalesce(F.col(text_col), F.lit(""))
    shards = stored(word_shards(docs.select(lang.alias("_lang"), text.alias("_t"))), "phrase-shards")
    size = shards.groupBy("lang").agg(F.sum("n_words").alias("n"))
    total = shards.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-total // BUCKET_WORDS))
    answers = stored(_frequent_words(_word_blocks(shards, buckets), min_count), "phrase-words")
    level = stored(_known(answers, "lang", "word").join(size, "lang").select("gid", "lang", "n", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("pre"), F.array("f").alias("suf")), "phrase-level-1")
    levels = []
    for d in range(1, max_words):
        before, answers = answers, stored(_frequent_phrases(_blocks(shards, answers.filter("shard is not null"), d, buckets), min_count), f"phrase-answers-{d + 1}")
        discard(before)
        head = level.select(F.col("gid").alias("pgid"), "lang", "n", "phrase", "pre", F.col("f").alias("pf"))
        tail = level.select(F.col("gid").alias("sgid"), "last", "suf", F.col("f").alias("sf"))
        wide = _known(answers, "pgid", "sgid").join(head, "pgid").join(tail, "sgid")
        longer = stored(wide.select("gid", "pgid", "sgid", "pf", "sf", "lang", "n", "f", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", F.array_append("pre", F.col("f")).alias("pre"), F.array_append("suf", F.col("f")).alias("suf")), f"phrase-level-{d + 1}")
        if d > 1:
            levels.append(_with_dropped(level, longer))
        level = longer
    discard(shards, answers)
    levels.append(level.withColumn("dropped", F.lit(False)))
    out = levels[0].select("lang", "phrase", "n", "f", "pre", "suf", "dropped")
    for x in levels[1:]:
        out = out.unionByName(x.select(*out.columns))
    return _scored(out)


def _with_dropped(level: DataFrame, longer: DataFrame) -> DataFrame:
    """The level with a mark on phrases that one of the next level holds and equals in count."""
    held = longer.filter("f = pf").select(F.col("pgid").alias("gid")).union(longer.filter("f = sf").select(F.col("sgid").alias("gid"))).distinct()
    return level.join(held.withColumn("dropped", F.lit(True)), "gid", "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)))


def _scored(phrases: DataFrame) -> DataFrame:
    """Score by the lowest cut, in decimals of 38 digits: counts up to 10**17 words stay exact."""
    wide = lambda x: f"cast({x} as decimal(17,0))"
    left, right = "pre[k - 1]", "suf[size(suf) - k - 1]"
    cut = f"named_struct('score', ({wide('f')} * {wide('n')} * 1000) div ({wide(left)} * {wide(right)}), 'cut', k, 'l', {left}, 'r', {right})"
    best = F.expr(f"array_min(transform(sequence(1, size(pre) - 1), k -> {cut}))")
    out = phrases.withColumn("best", best)
    return out.select("lang", "phrase", F.size("pre").alias("words"), F.col("f").alias("a"), "best.l", "best.r", "best.cut", "n", "best.score", "dropped")


def top_phrases(mined: DataFrame, top: int = 2000) -> DataFrame:
    """Columns of the query op12: each language's first `top` phrases. Parts of a language are cut to `top` first, so no task ranks a whole one."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = max(8, int(mined.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = mined.filter("not dropped").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def sql(table: str = "documents", min_count: int = 100, top: int = 2000) -> str:
    """DuckDB SQL for the query op12: all phrases counted outright."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS g FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM w)" for k in range(1, 6))
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM {table}),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {min_count}),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
x AS MATERIALIZED (SELECT lang, k, g, f, string_split(g, ' ') AS ws FROM g WHERE k >= 2),
held AS (SELECT DISTINCT y.lang, y.g FROM x y JOIN (SELECT lang, f, array_to_string(ws[1:k - 1], ' ') AS s FROM x UNION ALL SELECT lang, f, array_to_string(ws[2:k], ' ') FROM x) z ON y.lang = z.lang AND y.g = z.s AND z.f >= y.f),
c AS (SELECT lang, g, f, ws, k, unnest(range(1, k)) AS cut FROM x ANTI JOIN held USING (lang, g)),
s AS (SELECT c.lang, c.g, c.f, c.cut, n.n, a.f AS l, b.f AS r, CAST((1000 * CAST(c.f AS HUGEINT) * n.n) // (CAST(a.f AS HUGEINT) * b.f) AS BIGINT) AS score
 FROM c JOIN n USING (lang) JOIN g a ON a.lang = c.lang AND a.g = array_to_string(c.ws[1:c.cut], ' ') JOIN g b ON b.lang = c.lang AND b.g = array_to_string(c.ws[c.cut + 1:c.k], ' ')),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS o FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, g) AS rank FROM m WHERE o = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, g AS phrase, CAST(f AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM r WHERE rank <= {top}"""

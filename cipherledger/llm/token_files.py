"""Token ids in grammar-compressed shards (Re-Pair): frequent id pairs become nonterminals, round by round.

A shard row holds a run of documents in ascending id order: the rules, the number of ids each rule expands to, the
symbols, and for each document its symbols and ids, so that one document is read without expanding the others. Rules,
lengths and symbols are packed in as many bits as the greatest of them needs.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import views

#: Ids of one shard; a shard always holds whole documents.
SHARD_IDS = 1_000_000
#: The least number of places where a rule is put in: it costs two symbols and its length.
MIN_COUNT = 4
#: Passes over all pairs of a round before only the open ones are looked at.
PASSES = 3
#: Words that a worker remembers; beyond them, those stay that the texts at hand have.
WORDS = 250_000
#: Words of one call to the library, and words of letters in one text of it.
BATCH, JOINED = 20_000, 50
#: ASCII signs that never follow a letter within one token, and the mark of a token that ends a word.
SIGNS, WORD_END = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~', "</w>"
#: Bytes that aren't white space to the split, and text bytes that are encoded at a time.
SOLID = np.ones(256, bool)
SOLID[[9, 10, 13, 32]] = False
TEXT_BYTES = 8_000_000
SHARD = "part int, seq int, n_docs int, n_ids long, n_rules int, n_symbols long, base int, width int, len_width int, doc_ids binary, doc_lens binary, doc_symbols binary, rules binary, rule_lens binary, symbols binary"


def _matched(place: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the pairs at ascending places are replaced: of overlapping ones that of the best (least) rank first.

    The better of two neighbours wins wherever no better one touches it, over and over, which is the order of taking the
    most frequent pair of all each time. Runs of one pair count from their left end and give every second one.
    """
    taken = np.zeros(len(place), bool)
    live = np.arange(len(place))
    if len(place) and 4 * len(place) > place[-1] - place[0]:
        # Most are settled in a few passes over all neighbours, the left one of equals first; what is left, long runs too, by the loop below.
        none, at = np.int32(np.iinfo(np.int32).max), place - (place[0] - 1)
        dense, won = np.full(int(at[-1]) + 2, none, np.int32), np.zeros(int(at[-1]) + 2, bool)
        dense[at] = rank
        for _ in range(PASSES):
            here = dense[1:-1]
            best = np.flatnonzero((here < dense[:-2]) & (here <= dense[2:])) + 1
            won[best] = True
            dense[best - 1] = dense[best] = dense[best + 1] = none
        taken, live = won[at], np.flatnonzero(dense[at] != none)
    while len(live):
        at, r = place[live], rank[live]
        joins = np.diff(at) == 1  # with the next one
        same = np.zeros(len(live), bool)
        same[1:] = joins & (r[1:] == r[:-1])
        head = np.flatnonzero(~same)
        size = np.diff(np.append(head, len(live)))
        odd = (np.arange(len(live)) - np.repeat(head, size)) % 2
        # A run of equal pairs wins as a whole: against the pair before its first one and the pair behind its last one.
        before, behind = np.ones(len(head), bool), np.ones(len(head), bool)
        before[1:] = ~joins[head[1:] - 1] | (r[head[1:]] < r[head[1:] - 1])
        last = head + size - 1
        behind[:-1] = ~joins[last[:-1]] | (r[last[:-1]] < r[np.minimum(last[:-1] + 1, len(live) - 1)])
        won = np.repeat(before & behind, size) & (odd == 0)
        taken[live[won]] = True
        gone = won.copy()
        gone[1:] |= won[:-1] & joins
        gone[:-1] |= won[1:] & joins
        live = live[~gone]
    return taken


def _chosen(place: np.ndarray, rank: np.ndarray, n: int, min_count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places to replace, and which of the n pairs have min_count of them.

    Pairs may take each other's places until none has enough. Then those that have enough by themselves try again, the
    half with the fewest places left out each time, so one is found if there is one.
    """
    taken = _matched(place, rank)
    used = np.bincount(rank[taken], minlength=n)
    if (used < min_count).all() and n:
        same = np.concatenate(([False], (np.diff(place) == 1) & (np.diff(rank) == 0)))
        head = np.flatnonzero(~same)
        odd = (np.arange(len(place)) - np.repeat(head, np.diff(np.append(head, len(place))))) % 2
        able = np.flatnonzero(np.bincount(rank[odd == 0], minlength=n) >= min_count)
        while len(able):
            mine = np.flatnonzero(np.isin(rank, able))
            taken = np.zeros(len(place), bool)
            taken[mine] = _matched(place[mine], rank[mine])
            used = np.bincount(rank[taken], minlength=n)
            if (used >= min_count).any():
                break
            able = able[np.argsort(-used[able], kind="stable")[: len(able) // 2]]
    return taken & (used >= min_count)[rank], used >= min_count


def _by_pair(left: np.ndarray, right: np.ndarray, place: np.ndarray, half: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs as one number each, sorted, and their places in order."""
    key = left.astype(np.uint64)
    key <<= np.uint64(half)
    key |= right
    if 2 * half + bits > 64:
        order = np.argsort(key, kind="stable")
        return key[order], place[order]
    key <<= np.uint64(bits)  # a pair and its place in one number sort fastest
    key |= place.astype(np.uint64)
    key.sort()
    return key >> np.uint64(bits), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def _in_order(place: np.ndarray, rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Both by ascending place below n."""
    if 8 * len(place) < n:
        order = np.argsort(place)
        return place[order], rank[order]
    line = np.full(n, -1, np.int32)
    line[place] = rank
    place = np.flatnonzero(line >= 0)
    return place, line[place]


def compress(ids: np.ndarray, base: int, end_id: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (n x 2) and ids per rule. Nonterminal base+r stands for rules[r]; no rule holds the end id, so none crosses documents.

    A round counts adjacent pairs and gives one nonterminal to each pair that can be replaced min_count times, overlaps
    going to the most frequent pair (ties: smallest). Pairs that can be replaced in the next round hold a new symbol or
    lie where a pair found too few places, so only those are counted; when they give nothing, all are counted once more.
    It ends when no pair can be replaced min_count times.
    """
    seq, top = ids.astype(np.uint32), int(ids.max(initial=0))
    rules, lens = np.zeros((0, 2), np.uint32), np.zeros(0, np.uint32)
    fresh = np.ones(len(seq), bool)
    while len(seq) > 1:
        at = np.flatnonzero(fresh[:-1] | fresh[1:])
        left, right = seq[at], seq[at + 1]
        inside = (left != end_id) & (right != end_id)
        of, place = _by_pair(left[inside], right[inside], at[inside], max(top, base + len(rules)).bit_length(), len(seq).bit_length())
        first = np.flatnonzero(np.concatenate((np.ones(min(len(of), 1), bool), of[1:] != of[:-1])))
        n = np.diff(np.append(first, len(of)))
        enough = n >= min_count
        place, n, first = place[np.repeat(enough, n)], n[enough], first[enough]
        rank = np.empty(len(n), np.int32)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(n), dtype=np.int32)
        hit, of_hit = _in_order(place, np.repeat(rank, n), len(seq))
        done, used = _chosen(hit, of_hit, len(n), min_count)
        if not used.any():
            if fresh.all():
                break
            fresh[:] = True
            continue
        fresh[:] = False
        if not used.all():
            fresh[hit[~done]] = True  # too few places, or lost to a pair with too few
        hit, of_hit = hit[done], of_hit[done]
        pairs = np.empty((len(n), 2), np.uint32)
        pairs[of_hit, 0], pairs[of_hit, 1] = seq[hit], seq[hit + 1]
        pairs = pairs[used]
        seq[hit] = (np.cumsum(used) - 1 + len(rules) + base).astype(np.uint32)[of_hit]
        fresh[hit] = True
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq, fresh = seq[keep], fresh[keep]
        size = lambda s, lens=lens: np.where(s < base, 1, lens[np.maximum(s.astype(np.int64) - base, 0)] if len(lens) else 1)
        lens = np.concatenate((lens, (size(pairs[:, 0]) + size(pairs[:, 1])).astype(np.uint32)))
        rules = np.concatenate((rules, pairs))
    return seq, rules, lens


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    seq = symbols.astype(np.uint32)
    while len(seq) and (inner := seq >= base).any():
        at = np.cumsum(1 + inner) - 1 - inner
        out = np.empty(len(seq) + int(inner.sum()), np.uint32)
        pair = rules[seq[inner] - base]
        out[at] = np.where(inner, 0, seq)
        out[at[inner]], out[at[inner] + 1] = pair[:, 0], pair[:, 1]
        seq = out
    return seq


def expand_all(symbols: np.ndarray, rules: np.ndarray, lens: np.ndarray, base: int) -> np.ndarray:
    """expand() of many symbols: rules are expanded once, then copied; their lengths say where to."""
    flat = np.concatenate((np.arange(base, dtype=np.uint32), expand(base + np.arange(len(rules)), rules, base)))
    size = np.concatenate((np.ones(base, np.int64), lens))
    first, n = (np.cumsum(size) - size)[symbols], size[symbols]
    ends = np.cumsum(n)
    return flat[np.repeat(first - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def pack(values: np.ndarray, width: int) -> bytes:
    """Numbers of `width` bits each, low bits first."""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """The numbers start to stop - 1 of pack(); no other byte is read."""
    a = start * width
    raw = np.frombuffer(data, np.uint8, (stop * width + 7) // 8 - a // 8, a // 8)
    bits = np.zeros((stop - start, 32), np.uint8)
    bits[:, :width] = np.unpackbits(raw, bitorder="little")[a % 8 : a % 8 + (stop - start) * width].reshape(-1, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[k] to first[k] + size[k] - 1 for each k, one after another."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.repeat(first - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


class WordIds:
    """The library's ids of texts. Its pre-tokenizer cuts at white space, so ids are remembered by word.

    A new word is cut before its final ASCII signs where a letter stands before them, as the pre-tokenizer does. Words
    of letters alone are one token sequence each, whose last id is one of a word end; so many of them go to the library
    in one text, and ids of word ends tell them apart. If a text has more of these than words, its words go one by one.
    Words and their ids stay in columns, so there is no step of Python for a word.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        self.joins = all(t + WORD_END in vocab for t in vocab if len(t) == 1)
        self.known = pa.array([], pa.string())
        self.ids, self.lens = np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def _encode(self, texts: list[str], batch: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        out = [np.zeros(0, np.uint32)]
        for i in range(0, len(texts), batch):
            out += [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts[i : i + batch], add_special_tokens=False)]
        return np.concatenate(out), np.array([len(x) for x in out[1:]], np.int32)

    def _add_letters(self, words: pa.StringArray) -> np.ndarray:
        """Remembers words of letters alone; their places."""
        at = np.append(np.arange(0, len(words), JOINED), len(words)).astype(np.int32)
        ids, n = self._encode(pc.binary_join(pa.ListArray.from_arrays(at, words), " ").to_pylist(), BATCH // JOINED)
        end, line = self.ends[ids], np.repeat(np.arange(len(n)), n)
        good = (np.bincount(line[end], minlength=len(n)) == np.diff(at)) & end[np.cumsum(n) - 1]
        kept, mine, places = good[line], np.repeat(good, np.diff(at)), np.empty(len(words), np.int64)
        places[mine] = self._add(words.filter(pa.array(mine)), ids[kept], np.diff(np.flatnonzero(end[kept]), prepend=-1))
        places[~mine] = self._add_each(words.filter(pa.array(~mine)))
        return places

    def _add_each(self, words: pa.StringArray) -> np.ndarray:
        return self._add(words, *self._encode(words.to_pylist()))

    def _add(self, words: pa.StringArray, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Remembers words that aren't known, with their ids and how many each has; their places."""
        self.known = pa.concat_arrays([self.known, words])
        self.ids, self.lens = np.concatenate((self.ids, ids)), np.concatenate((self.lens, lens.astype(np.int32)))
        return np.arange(len(self.known) - len(words), len(self.known))

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the known words at these places, and how many each has."""
        lens = self.lens[at]
        return self.ids[_runs((np.cumsum(self.lens, dtype=np.int64) - self.lens)[at], lens)], lens

    def _places(self, words: pa.StringArray) -> np.ndarray:
        """Places of words among the known ones, -1 for others."""
        return pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)

    def learn(self, words: pa.StringArray) -> np.ndarray:
        """Places of these distinct words among the known ones, which they join."""
        if len(self.known) > WORDS:
            used = np.unique(self._places(words))
            used = used[used >= 0]
            self.ids, self.lens = self._ids(used)
            self.known = self.known.take(pa.array(used))
        at = self._places(words)
        fresh = at < 0
        if not fresh.any():
            return at
        new = words.filter(pa.array(fresh))
        core = pc.utf8_rtrim(new, SIGNS)
        cut = pc.and_(pc.not_equal(core, new), pc.utf8_is_alpha(pc.utf8_slice_codeunits(core, -1, None)))
        core = pc.if_else(cut, core, new)
        sized = pc.subtract(pc.binary_length(new), pc.binary_length(core)).to_numpy()
        stops = np.frombuffer(new.buffers()[1], np.int32, len(new) + 1, 4 * new.offset)[1:]
        data = np.frombuffer(new.buffers()[2], np.uint8)[_runs(stops - sized, sized)]
        cut = sized > 0
        tail = pa.StringArray.from_buffers(len(new), pa.py_buffer(np.append(0, np.cumsum(sized)).astype(np.int32)), pa.py_buffer(data)).filter(pa.array(cut))
        parts = pa.concat_arrays([core, tail]).dictionary_encode()
        of = self._places(parts.dictionary)
        letters = pc.utf8_is_alpha(parts.dictionary).to_numpy(zero_copy_only=False) & self.joins
        for mine, add in (((of < 0) & letters, self._add_letters), ((of < 0) & ~letters, self._add_each)):
            if mine.any():
                of[mine] = add(parts.dictionary.filter(pa.array(mine)))
        of = of[parts.indices.to_numpy()]
        mine = of[: len(new)]
        ids, lens = self._ids(np.stack((mine[cut], of[len(new) :]), 1).ravel())
        mine[cut] = self._add(new.filter(pa.array(cut)), ids, lens.reshape(-1, 2).sum(1))
        at[fresh] = mine
        return at

    def encode(self, data: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[off[k]:off[k + 1]], each with the end id, and the number of ids of each."""
        n = len(off) - 1
        solid = SOLID[data]
        fresh = np.ones(len(data) + 1, bool)  # after a gap or at a text's start
        np.logical_not(solid, out=fresh[1:])
        fresh[off] = True
        start = np.flatnonzero(solid & fresh[:-1])
        body = data[solid]
        before = np.cumsum(solid, dtype=np.int32)  # a word's bytes count, the gaps behind it don't
        where = np.append(before[start] - 1, len(body)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(where), pa.py_buffer(body)).dictionary_encode()
        flat, lens = self._ids(self.learn(words.dictionary))
        flat, lens = np.append(flat, np.uint32(end_id)), np.append(lens, np.int32(1))
        first = np.cumsum(lens, dtype=np.int32) - lens
        cuts = np.searchsorted(start, off[1:])
        seq = np.insert(words.indices.to_numpy(), cuts, len(lens) - 1)
        count = lens[seq]
        ends = np.cumsum(count, dtype=np.int32)
        out = flat[np.repeat(first[seq] - ends + count, count) + np.arange(int(ends[-1]) if n else 0, dtype=np.int32)]
        return out, np.diff(ends[cuts + np.arange(n)], prepend=0)


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _shard(part: int, seq: int, docs: list[tuple[int | None, np.ndarray]], base: int, end_id: int) -> pa.RecordBatch:
    ids = np.concatenate([x for _, x in docs])
    lens = np.array([len(x) for _, x in docs], np.uint32)
    symbols, rules, rule_lens = compress(ids, base, end_id)
    size = np.where(symbols < base, 1, rule_lens[np.maximum(symbols.astype(np.int64) - base, 0)] if len(rule_lens) else 1)
    ends = np.searchsorted(np.cumsum(size), np.cumsum(lens)) + 1
    width, len_width = (max(int(x.max(initial=0)), 1).bit_length() for x in (np.concatenate((symbols, rules.ravel())), rule_lens))
    none = -(1 << 63)
    row = [part, seq, len(docs), len(ids), len(rules), len(symbols), base, width, len_width]
    row += [x.tobytes() for x in (np.array([none if d is None else d for d, _ in docs], "<i8"), lens, np.diff(ends, prepend=0).astype("<u4"))]
    row += [pack(rules.ravel(), width), pack(rule_lens, len_width), pack(symbols, width)]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SHARD.split(", ")])


def _rules(row: dict) -> np.ndarray:
    return unpack(row["rules"], row["width"], 0, 2 * row["n_rules"]).reshape(-1, 2)


def write_token_files(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Writes shards of the documents in ascending id order (equal ids by text, null ids first; null text is empty).

    Every row counts, repeated ones too; an empty text is the end id alone; an empty table gives files without a shard.
    A text of any length is one document and lies whole in one shard, which it may fill alone. Other columns aren't read,
    whatever their names.
    """
    spark = docs.sparkSession
    n = partitions or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = word_ids(tokenizer_file), TaskContext.get().partitionId()
        seq, held, size = 0, [], 0
        for b in batches:
            for x, y, data, off in views(b, "_t", TEXT_BYTES):
                ids, lens = tok.encode(data, off, end_id)
                for d, doc in zip(b.column("_id").slice(x, y - x).to_pylist(), np.split(ids, np.cumsum(lens)[:-1]), strict=True):
                    held.append((d, doc))
                    size += len(doc)
                    if size >= SHARD_IDS:
                        yield _shard(part, seq, held, tok.size, end_id)
                        seq, held, size = seq + 1, [], 0
        if held:
            yield _shard(part, seq, held, tok.size, end_id)

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    rows.repartitionByRange(n, "_id").sortWithinPartitions("_id", "_t").mapInArrow(run, SHARD).write.parquet(path)


def _documents(row: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the shard, ids) of a shard row."""
    rule_lens = unpack(row["rule_lens"], row["len_width"], 0, row["n_rules"])
    ids = expand_all(unpack(row["symbols"], row["width"], 0, row["n_symbols"]), _rules(row), rule_lens, row["base"])
    lens = np.frombuffer(row["doc_lens"], "<u4").astype(np.int64)
    at = np.cumsum(lens) - lens
    for d, a, k in zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), at.tolist(), lens.tolist(), strict=True):
        yield (None if d == -(1 << 63) else d), a, ids[a : a + k]


def document_ids(row: dict, doc_id: int) -> np.ndarray:
    """Ids of one document of a shard row: only its own symbols are expanded."""
    at = int(np.flatnonzero(np.frombuffer(row["doc_ids"], "<i8") == doc_id)[0])
    n = np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64)
    a = int(n[:at].sum())
    return expand(unpack(row["symbols"], row["width"], a, a + int(n[at])), _rules(row), row["base"])


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, start counting all ids before it in the files' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                got = list(_documents(row))
                cols = [pa.array([d for d, _, _ in got], pa.int64()), pa.array([a for _, a, _ in got], pa.int64()), pa.array([len(x) for _, _, x in got], pa.int64())]
                cols.append(pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, _, x in got], pa.int64()))
                if with_ids:
                    cols.append(pa.array([x.astype(np.int32) for _, _, x in got], pa.list_(pa.int32())))
                key = [pa.array([row[k]] * len(got), pa.int32()) for k in ("part", "seq")]
                yield pa.RecordBatch.from_arrays(key + cols, names=["part", "seq", "doc_id", "_at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    shards = spark.read.schema(SHARD).parquet(path)
    sizes = shards.select("part", "seq", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    parts = parts.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    inner = Window.partitionBy("part").orderBy("seq")
    starts = sizes.withColumn("_in", F.sum("n_ids").over(inner) - F.col("n_ids")).join(parts, "part").select("part", "seq", (F.col("_in") + F.col("_before")).alias("_start"))
    rows = shards.mapInArrow(run, "part int, seq int, doc_id long, _at long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))
    out = ["doc_id", (F.col("_start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32"] + (["ids"] if with_ids else [])
    return rows.join(starts, ["part", "seq"]).select(*out)

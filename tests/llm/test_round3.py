"""License scan, phrase mining, periodic runs and the grammar of ids against brute force on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cipherledger.llm import license_scan, periodic_runs, phrase_index, token_files

DOC = "doc_id long, text string, lang string, source string, n_chars long, _t string, _id string, runs int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _frame(spark, rows):
    """rows of (doc_id, text, lang); the other columns clash with names in use."""
    return spark.createDataFrame([(i, t, lang, None, None, "x", "y", 1) for i, t, lang in rows], DOC).repartition(3)


def _runs(w):
    """All runs, by the definition: each lag, each stretch, smallest period only."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def test_lag_scan_equals_definition():
    r = random.Random(3)
    for k in range(400):
        w = [r.randint(0, r.choice([0, 1, 2, 6])) for _ in range(r.randint(0, 90))]
        if k % 3 == 0 and w:
            p = r.randint(1, 30)
            w = w[:20] + [w[i % min(p, len(w))] for i in range(r.randint(0, 150))] + w[20:]
        ids = np.array(w, np.int64)
        got = []
        for s, e in zip(*periodic_runs.surviving_segments(ids, np.array([0]), np.array([len(w)])), strict=True):
            got += [(int(s) + x, n, q) for x, n, q in periodic_runs.lag_scan(ids[s:e])]
        assert sorted(got) == _runs(w), w


def _op13(i, text):
    w = WORD.findall(text or "")
    n = len(w)
    if i is not None and n:
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = _runs(w)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *head, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_runs_of_documents(spark):
    r = random.Random(5)
    texts = [None, "", "  \t\n ", "a a a a a a", "x\ty " * 12 + "\n", "no run at all here", "é " * 9 + "é", "a b c " * 7, "z " * 6 + "z\x1cz"]
    for _ in range(60):
        texts.append(" ".join(r.choice(["the", "of", "Épée", "ß", "x"]) + str(r.randint(0, r.choice([0, 30]))) for _ in range(r.randint(1, 200))))
    rows = [(k if k % 11 else 10, t, None) for k, t in enumerate(texts * 2)] + [(None, "b c " * 8, None)]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows if i is not None)
    got = [tuple(x) for x in periodic_runs.runs_of_documents(_frame(spark, rows)).collect()]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(got, key=key) == sorted((_op13(i, t) for i, t, _ in rows), key=key)
    assert periodic_runs.runs_of_documents(_frame(spark, [])).count() == 0


def test_long_text_of_one_run(spark):
    text = " ".join(["w"] * 300_000) + " end " + " ".join(f"u{k % 5000}" for k in range(40_000))
    row = periodic_runs.find_runs(_frame(spark, [(7, text, None)])).first()
    assert [tuple(x) for x in row.runs] == [(0, 300_000, 1), (300_001, 40_000, 5000)]
    assert row.collapsed == "w end " + " ".join(f"u{k}" for k in range(5000))


def _same_as_sql(df, sql, docs, tmp_path):
    """Rows of a query against its SQL over the same small table."""
    import duckdb

    docs.write.mode("overwrite").parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    q = con.execute(sql)
    names = [c[0] for c in q.description]
    assert sorted(names) == sorted(df.columns)
    tidy = lambda rows: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows], key=str)
    got, want = tidy(tuple(r[c] for c in names) for r in df.collect()), tidy(q.fetchall())
    assert got == want
    return [dict(zip(names, r, strict=True)) for r in got]


def _licence_texts():
    r = random.Random(11)
    notices = [t.words for t in license_scan.NOTICES if not t.phrase]
    out = [None, "", " \t ", "MIT License", "mit", "the MITé license", "gnu general public license gnu general public license v3", "CC BY-NC 4, or cc-by!", "Apache License, apache licens e", "GNU general public"]
    for k in range(120):
        w = list(r.choice(notices))
        for _ in range(r.choice([0, 1, 3, 8, 30])):
            at = r.randrange(len(w))
            what = r.randrange(3)
            w[at : at + (what != 1)] = [] if what == 0 and len(w) > 9 else ["zz" + str(r.randint(0, 9))]
        pad = [r.choice(["of", "the", "license", "software", "permission", "mit", "to", "use"]) for _ in range(r.randint(0, 60))]
        out.append(" ".join(pad + w + pad[::-1] + (w if k % 7 == 0 else [])).title())
    return out + out[3:9] + ["x y " * 6000 + "mit license " + "q " * 4094 + "gnu general public license"]


def test_license_scan_equals_sql(spark, tmp_path):
    rows = [(k % 97 if k != 5 else None, t, "en") for k, t in enumerate(_licence_texts())]
    docs = _frame(spark, rows)
    got = _same_as_sql(license_scan.digest(license_scan.scan_licenses(docs)), license_scan.sql(), docs, tmp_path)
    assert {"mit", "apache", "bsd", "cc-by,cc-by-nc"} <= {x["labels"] for x in got} and min(x["score"] for x in got) == 0.0
    assert any(0.8 <= x["score"] < 1 for x in got)
    assert license_scan.scan_licenses(_frame(spark, [])).count() == 0


def test_license_base_equals_definition(spark):
    rows = [(k, t, None) for k, t in enumerate(_licence_texts())]
    want = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = [(k, x.label) for x in license_scan.BASE for k in range(len(w)) if w[k : k + len(x.words)] == x.words]
        starts = [k for k, _ in at]
        want.append((i, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))))
    got = license_scan.digest(license_scan.scan_licenses(_frame(spark, rows))).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert sorted(map(tuple, got.collect())) == want


def _phrase_rows():
    r = random.Random(13)
    words = ["new", "york", "city", "of", "the", "Épée", "ß", "ß\x1cx", "日本", "x-y", "#"]
    out = [(1, None, "en"), (2, "", None), (3, "...;\n", "de"), (4, "solo", "xx")]
    for k in range(260):
        t = "".join(r.choice(words[: r.randint(3, 11)]) + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\r\n", " New York City! "]) for _ in range(r.randint(1, 60)))
        out.append((k % 200, t, r.choice(["en", "en", "en", None, "und", "fr"])))
    return out + [(900 + k, "the same words again and again, the same words", "fr") for k in range(15)] + [(999, "a b " * 4000, "en")]


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_phrases_equal_sql(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(phrase_index, "SHARD_WORDS", limit)
    monkeypatch.setattr(phrase_index, "MIN_BUCKETS", 5)
    docs = _frame(spark, _phrase_rows())
    got = _same_as_sql(phrase_index.top_phrases(phrase_index.mine_phrases(docs, min_count=10), 60), phrase_index.sql(min_count=10, top=60), docs, tmp_path)
    assert {x["lang"] for x in got} == {"en", "fr", "und"} and any(x["phrase"].count(" ") == 4 for x in got)
    assert phrase_index.top_phrases(phrase_index.mine_phrases(_frame(spark, []))).count() == 0


def test_index_equals_counting():
    """Both key widths: packed into 63 bits and compared column by column."""
    r = random.Random(2)
    for _ in range(60):
        codes = np.array([0] + [r.choice([0, 1, 1, 2, 3, 4]) for _ in range(r.randint(0, 120))] + [0], np.int64)
        grams = lambda d: Counter(tuple(codes[i : i + d]) for i in range(len(codes) - d + 1) if 0 not in codes[i : i + d])  # noqa: E731, B023
        row = lambda seq, g, n=len(codes): sum(tuple(np.append(seq, [0] * 9)[i : i + len(g)]) < g for i in range(n))
        for d in range(1, 5):
            known = sorted(g for g, c in grams(d).items() if c > 1)
            lo = np.array([row(codes, g) for g in known], np.int64)
            want = {g: c for g, c in grams(d + 1).items() if g[:-1] in known and g[1:] in known}
            first, last, size, new_lo = phrase_index.extend(codes, d, lo)
            got = [known[a] + known[b][-1:] for a, b in zip(first, last, strict=True)]
            assert dict(zip(got, size.tolist(), strict=True)) == want
            assert [row(codes, g) for g in got] == new_lo.tolist()
    x = np.array([r.randint(0, 9) for _ in range(500)])
    assert (phrase_index._order(x, x[::-1], 21) == phrase_index._order(x, x[::-1], 40)).all()


def _replaceable(seq, end_id):
    """The greatest number of places where one pair can be replaced, overlaps of a pair with itself taken from the left."""
    most, last, count = 0, {}, {}
    for i, pair in enumerate(zip(seq[:-1], seq[1:], strict=True)):
        if end_id not in pair and last.get(pair, -2) != i - 1:
            last[pair], count[pair] = i, count.get(pair, 0) + 1
            most = max(most, count[pair])
    return most


@pytest.mark.parametrize("kinds, n", [(3, 400), (6, 5000), (40, 20000), (1, 1000), (2, 3)])
def test_grammar_ends_when_no_pair_can_be_replaced(kinds, n):
    r = np.random.default_rng(kinds)
    ids = r.integers(2, 2 + kinds, n).astype(np.uint32)
    ids[r.random(n) < 0.02] = 1
    symbols, rules, lens = token_files.compress(ids, 50, 1)
    assert (token_files.expand(symbols, rules, 50) == ids).all()
    assert (token_files.expand_all(symbols, rules, lens, 50) == ids).all()
    assert 1 not in rules and _replaceable(symbols.tolist(), 1) < token_files.MIN_COUNT


def test_grammar_of_copies_keeps_one_of_them():
    doc = np.append(np.random.default_rng(4).integers(2, 5000, 3000), 1).astype(np.uint32)
    symbols, rules, lens = token_files.compress(np.tile(doc, 64), 5000, 1)
    assert len(symbols) == 2 * 64 and lens.max() == 3000 and len(rules) < 3000


@pytest.mark.parametrize("width", [1, 5, 8, 16, 17, 31, 32])
def test_packed_numbers_come_back_from_any_place(width):
    x = np.random.default_rng(width).integers(0, 1 << width, 777, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack(x, width)
    assert len(data) == (777 * width + 7) // 8
    for a, b in ((0, 777), (5, 5), (0, 0), (13, 14), (100, 700), (777, 777)):
        assert (token_files.unpack(data, width, a, b) == x[a:b]).all()

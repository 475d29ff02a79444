"""The pipeline's stages on a small table, each against what it must keep, and run() against a plain version."""

from __future__ import annotations

import hashlib
import re

import corpus_pipeline
import duckdb
import pandas as pd
import public_tokenizers
import pytest

from cipherledger.llm import line_rules, mixing
from cipherledger.llm.common import stored

KIND = "doc_id long, text string, lang string, source string, n_chars long, extra string, rep string, component_id long"


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    before = None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, d), f"t{k}")
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if k == 0:
            assert ids == {r.doc_id for r in line_rules.line_quality(docs).filter("kept").collect()}
        if k < 4:
            assert out.columns == docs.columns
        assert before is None or ids <= before
        before, docs = ids, out
    assert docs.filter("n_tokens <> size(ids)").count() == 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, "x", "y", 1), (1, "", "en", "src0", 0, "x", "y", 1), (1, "", "en", "src0", 0, "x", "y", 1), (2, "two words", None, None, 9, None, None, None)]])
def test_stages_on_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, KIND)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, "").count() <= len(rows)
    assert corpus_pipeline.quality_rules(spark, docs, "").count() == 0
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == len(rows)
    assert corpus_pipeline.repeated_passages(spark, docs, "").count() == len(rows)


def _good_lines(text):
    """Lines that pass, and their words, by the rules as the line module states them."""
    kept, words = [], 0
    for line in text.split("\n"):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", line))
        bad = len(re.findall("[|»>•]", line)) * 5 >= n + 4 or len(re.findall("!!", line)) * 10 > n * 3 or len(re.findall(r"[#*$%&|<>]", line)) * 2 > n
        bad = bad or (n >= 4 and not re.search("[.!?…:;]", line)) or (n <= 20 and re.search(line_rules.BOILERPLATE, line.lower()))
        if n == 0 or not bad:
            kept.append(line)
            words += n
    return "\n".join(kept), words


def _base_failed(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    where: dict[tuple, list[int]] = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {j for at in where.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    return len(w) < 50 or 100 * len(again) > 50 * len(w)


def _components(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    part = {i: i for i in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                part[q] = p
    return {i: find(i) for i in part}


def test_run_equals_plain_version(spark):
    import sentencepiece

    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    texts = {}
    for i, r in rows.items():
        clean, words = _good_lines(r.text or "")
        if not _base_failed(r.text or "") and words * 2 >= len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")):
            texts[i] = clean
    part = _components(texts)
    texts = {i: t for i, t in texts.items() if part[i] == i}
    seen: set[bytes] = set()
    for i in sorted(texts):
        body = texts[i].encode()
        gone = bytearray(len(body))
        wins = [body[k : k + 50] for k in range(len(body) - 49)]
        for k, w in enumerate(wins):
            if w in seen:
                gone[k : k + 50] = b"\x01" * 50
        seen.update(wins)
        at, kept = 0, ""
        for c in texts[i]:
            k = len(c.encode())
            kept += "" if all(gone[at : at + k]) else c
            at += k
        texts[i] = kept
    docs = pd.DataFrame([(i, t, rows[i].lang, rows[i].source) for i, t in texts.items()], columns=["doc_id", "text", "lang", "source"])
    con = duckdb.connect()
    con.register("documents", docs)
    chosen = [r[0] for r in con.execute(mixing.sql(columns="doc_id")).fetchall()]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i in chosen:
        ids = sp.encode(texts[i])
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), ids))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in corpus_pipeline.run(spark, d).collect()]
    assert sorted(got) == sorted(want) and len(got) > 5

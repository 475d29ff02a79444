"""License scan by diagonal voting.

All rolling word k-gram hashes of the texts are joined to the places that the same hashes have in the templates. Hits with
the same template and the same offset (word of the text less word of the template) lie on one diagonal; their number is
its vote. Neighbouring diagonals, a few inserted or lost words apart, are merged; spans with votes enough are verified
word by word against the template. Phrases are templates too, of the shorter k, and must match whole on one diagonal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounds_of, mix, prefix_hash, range_hash, release, stored, views

#: Words of a k-gram: of phrases, and of longer templates.
PHRASE_K, TEXT_K = 2, 4
#: Diagonals of a longer template this near belong to one span.
SLACK = 6
#: Share of a longer template's words that a span must hold.
MIN_SHARE = 0.8
#: Words of a piece of a text, whose hashes travel as one array.
PIECE = 4096
#: Template places up to which the table of templates is broadcast; beyond it Spark shuffles both sides.
MAX_BROADCAST = 200_000
#: Bits of the table that says which texts may have a candidate: 1 MB whatever the input.
MARK_BITS = 23


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", self.text.translate({c: c + 32 for c in range(65, 91)}))

    @property
    def k(self) -> int:
        return PHRASE_K if self.phrase else TEXT_K

    @property
    def slack(self) -> int:
        return 0 if self.phrase else SLACK

    @property
    def min_votes(self) -> int:
        """Fewest hits of a span that is accepted: each word amiss costs k hits at most, so none is lost."""
        n = len(self.words)
        return n - self.k + 1 if self.phrase else max(1, n - self.k + 1 - self.k * (n - self.min_words))

    @property
    def min_words(self) -> int:
        n = len(self.words)
        return n if self.phrase else -(-int(round(MIN_SHARE * 100)) * n // 100)


# The contract's phrases.
BASE = (
    Template("gpl", "gnu general public license", True, True),
    Template("apache", "apache license", True, True),
    Template("cc-by", "cc by", True, True),
    Template("mit", "mit license", True, True),
)
#: Public notices; a label may have several templates.
NOTICES = (
    Template("cc-by-nc", "CC BY-NC", True),
    Template("cc-by-sa", "CC BY-SA", True),
    Template("cc-by-nd", "CC BY-ND", True),
    Template("cc0", "CC0 1.0", True),
    Template("bsd", "BSD License", True),
    Template("lgpl", "GNU Lesser General Public License", True),
    Template("agpl", "GNU Affero General Public License", True),
    Template("mpl", "Mozilla Public License", True),
    Template("epl", "Eclipse Public License", True),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2 0"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)
TEMPLATES = BASE + NOTICES


def lowered(data: np.ndarray) -> np.ndarray:
    return data + 32 * ((data >= 65) & (data <= 90)).astype(np.uint8)


def scan_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the words of lowered bytes: digits, letters and all bytes beyond ASCII."""
    return bounds_of((data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)), off)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words from their hashes; another k, another hash."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return out


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(data), start, end)


def template_places(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(hash, tpl, t_pos): where each k-gram stands in each template."""
    rows = []
    for i, t in enumerate(templates):
        if len(t.words) < t.k:
            raise ValueError(f"template {t.label!r} has fewer than {t.k} words")
        data = np.frombuffer(" ".join(t.words).encode(), np.uint8)
        start, end, _ = scan_words(data, np.array([0, len(data)]))
        rows += [(int(x), i, p) for p, x in enumerate(gram_hashes(word_hashes(data, start, end), t.k).view(np.int64))]
    if any(h == 0 for h, _, _ in rows):
        raise ValueError("a template's hash is 0, which stands for no k-gram")
    out = spark.createDataFrame(rows, "hash long, tpl int, t_pos int")
    return F.broadcast(out) if len(rows) <= MAX_BROADCAST else out


def rolling_hashes(docs: DataFrame) -> DataFrame:
    """(_id, _th, base, hashes): both k-gram hashes of every word of a piece, in turn; 0 where the text ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, data, off in views(b, "_t"):
                data = lowered(data)
                start, end, row = scan_words(data, off)
                words = np.searchsorted(row, np.arange(z - a + 1))
                h = word_hashes(data, start, end)
                both = np.zeros((len(h), 2), np.uint64)
                for f, k in enumerate((PHRASE_K, TEXT_K)):
                    g = gram_hashes(h, k)
                    whole = np.arange(len(g)) + k <= words[row[: len(g)] + 1]
                    both[: len(g), f][whole] = g[whole]
                pieces = np.maximum(1, -(-np.diff(words) // PIECE))
                of = np.repeat(np.arange(z - a), pieces)
                base = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
                lists = pa.ListArray.from_arrays(pa.array(np.append(words[of] + base, len(h)).astype(np.int32) * 2), pa.array(both.view(np.int64).ravel()))
                at = pa.array(of + a)
                yield pa.RecordBatch.from_arrays([b.column("_id").take(at), b.column("_th").take(at), pa.array(base), lists], names=["_id", "_th", "base", "hashes"])
            release()

    return docs.mapInArrow(run, "_id long, _th long, base long, hashes array<long>")


def candidate_spans(docs: DataFrame, places: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(_id, _th, spans array of (tpl, diagonals)): merged diagonals with votes enough. Repeated rows vote once, as places are sets."""
    grams = rolling_hashes(docs).select("_id", "_th", "base", F.posexplode("hashes").alias("at", "hash"))
    hits = grams.join(places, "hash").select("_id", "_th", "tpl", "t_pos", (F.col("base") + F.floor(F.col("at") / 2) - F.col("t_pos")).alias("diagonal"))
    votes = hits.groupBy("_id", "_th", "tpl", "diagonal").agg(F.size(F.collect_set("t_pos")).alias("votes"))
    by = Window.partitionBy("_id", "_th", "tpl").orderBy("diagonal")
    per = lambda name: F.element_at(F.array(*[F.lit(getattr(t, name)) for t in templates]), F.col("tpl") + 1)
    gap = F.col("diagonal") - F.lag("diagonal").over(by)
    merged = votes.withColumn("new", F.when(gap <= per("slack"), 0).otherwise(1)).withColumn("span", F.sum("new").over(by))
    spans = merged.groupBy("_id", "_th", "tpl", "span").agg(F.sum("votes").alias("votes"), F.sort_array(F.collect_list("diagonal")).alias("diagonals"))
    spans = spans.filter(F.col("votes") >= per("min_votes"))
    return spans.groupBy("_id", "_th").agg(F.collect_list(F.struct("tpl", "diagonals")).alias("spans"))


def candidate_marks(spans: DataFrame, bits: int = MARK_BITS) -> np.ndarray:
    """A bit for each remainder of the text hash that a candidate has: 2**bits / 64 numbers at most, whatever the input."""
    spot = F.col("_th").bitwiseAND(F.lit((1 << bits) - 1))
    rows = spans.groupBy(F.shiftright(spot, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_th & 63 as int))")).alias("x")).collect()
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in rows:
        out[r["at"]] = r["x"]
    return np.unpackbits(out.view(np.uint8), bitorder="little")


SPAN = "struct<label:string,base:boolean,start:long,end:long,share:double>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(id, n_words, spans array of (label, base, start, end, share)) for every row: verified spans in words from 0, end excluded, by start.

    Null and empty texts have no words and no spans. Texts are read whole, twice; only texts that share their mark with a
    candidate are shuffled. Repeated rows and ids each get their own row: texts are known by id and 64-bit hash while
    candidates are sought, and each row is verified on its own words. Null ids keep their row. An empty table gives an
    empty one. Other columns aren't read, so their names can't clash. Two spans of one template closer than
    SLACK diagonals count as one.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_th"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    spans = stored(candidate_spans(src, template_places(spark, templates), templates), "license-spans")
    marks = candidate_marks(spans)
    mask = np.int64(len(marks) - 1)

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The number of words of each text, and the text itself only where it may have a candidate."""
        for b in batches:
            may = marks[b.column("_th").to_numpy(zero_copy_only=False) & mask].astype(bool)
            n = [np.bincount(scan_words(lowered(data), off)[2], minlength=z - a) for a, z, data, off in views(b, "_t")]
            text = pc.if_else(pa.array(may), b.column("_t"), pa.scalar(None, b.column("_t").type)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_th"), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64()), text], names=["_id", "_th", "n_words", "_t"])
            release()

    tables = [(t.label, t.base, t.words, t.min_words) for t in templates]
    encoded = [[w.encode() for w in words] for _, _, words, _ in tables]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[dict]] = []
            for text, cand in zip(b.column("_t"), b.column("spans"), strict=True):
                found: list[dict] = []
                if cand.is_valid and text.is_valid:
                    data = lowered(np.frombuffer(text.as_py().encode(), np.uint8))
                    start, end, _ = scan_words(data, np.array([0, len(data)]))
                    raw = data.tobytes()
                    for c in cand.as_py():
                        label, base, words, least = tables[c["tpl"]]
                        ds, want = c["diagonals"], encoded[c["tpl"]]
                        hit = [(t, t + d) for t in range(len(words)) for d in ds if 0 <= t + d < len(start) and raw[start[t + d] : end[t + d]] == want[t]]
                        n = len({t for t, _ in hit})
                        if n >= least:
                            found.append(dict(label=label, base=base, start=min(at for _, at in hit), end=max(at for _, at in hit) + 1, share=n / len(words)))
                out.append(sorted(found, key=lambda s: (s["start"], s["end"], s["label"])))
            kind = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("n_words"), pa.array(out, pa.list_(kind))], names=["_id", "n_words", "spans"])

    thin = src.mapInArrow(slim, "_id long, _th long, n_words long, _t string")
    found = spans.select(F.col("_id").alias("_i"), F.col("_th").alias("_h"), "spans")
    joined = thin.join(found, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_h")), "left").select("_id", "n_words", "_t", "spans")
    return joined.mapInArrow(verify, f"_id long, n_words long, spans array<{SPAN}>").withColumnRenamed("_id", id_col)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Columns of the query op11."""
    base = F.filter("spans", lambda s: s["base"])
    names = lambda x: F.array_join(F.sort_array(F.array_distinct(F.transform(x, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return scanned.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def sql(table: str = "documents", templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB SQL for the query op11: k-grams as lists of words in place of hashes."""
    rows = ", ".join(f"({i}, '{t.label}', {str(t.base).lower()}, {t.k}, {t.slack}, {t.min_votes}, {t.min_words}, string_split('{' '.join(t.words)}', ' '))" for i, t in enumerate(templates))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}),
t(tpl, label, base, k, slack, min_votes, min_words, tw) AS (VALUES {rows}),
tg AS (SELECT tpl, k, p - 1 AS t_pos, array_to_string(tw[p:p + k - 1], ' ') AS g FROM (SELECT tpl, k, tw, unnest(range(1, len(tw) - k + 2)) AS p FROM t)),
dg AS (SELECT rid, {PHRASE_K} AS k, p - 1 AS spot, w[p] || ' ' || w[p + 1] AS g FROM (SELECT rid, w, unnest(range(1, len(w))) AS p FROM d)
 UNION ALL SELECT rid, {TEXT_K}, p - 1, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] FROM (SELECT rid, w, unnest(range(1, len(w) - 2)) AS p FROM d)),
v AS (SELECT rid, tpl, spot - t_pos AS diagonal, count(*) AS votes FROM dg JOIN tg USING (k, g) GROUP BY ALL),
m AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, tpl ORDER BY diagonal) <= slack THEN 0 ELSE 1 END AS fresh FROM v JOIN t USING (tpl)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, tpl ORDER BY diagonal) AS span FROM m),
c AS (SELECT rid, tpl, span, list(diagonal) AS ds FROM s GROUP BY rid, tpl, span, min_votes HAVING sum(votes) >= min_votes),
x AS (SELECT rid, tpl, span, q, dd + q AS spot FROM (SELECT rid, tpl, span, unnest(ds) AS dd, tw FROM c JOIN t USING (tpl)), LATERAL (SELECT unnest(range(0, len(tw))) AS q)),
y AS (SELECT rid, tpl, span, count(DISTINCT q) AS n, min(spot) AS start FROM x JOIN d USING (rid) JOIN t USING (tpl) WHERE spot >= 0 AND spot < len(w) AND w[spot + 1] = tw[q + 1] GROUP BY ALL),
z AS (SELECT rid, label, base, start, n / len(tw) AS share FROM y JOIN t USING (tpl) WHERE n >= min_words),
f AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS a, max(start) FILTER (WHERE base) AS b,
 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS al, max(share) AS score FROM z GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word,
 coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, coalesce(CAST(score AS DOUBLE), 0.0) AS score
FROM d LEFT JOIN f USING (rid)"""

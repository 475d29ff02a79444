"""Quality rules, line first: lines that fail a rule go, then documents that lost too much text go.

All of it is DataFrame functions on one row at a time: no shuffle, no Python, no row of intermediate data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, let, text_of, words_of

#: Symbols that the base statistics count.
SYMBOLS = "#*$%&|<>"
#: Phrases of licence, consent and account lines.
BOILERPLATE = r"all rights reserved|licensed under|released under the|cookie|terms of (use|service)|privacy policy|enable javascript"
#: A line with none of these anywhere isn't prose.
SENTENCE_MARK = r"[.!?…:;]"
#: Words a line must have before the missing-punctuation rule applies.
MIN_PROSE_WORDS = 4


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the array: windows are sorted with their positions, equal neighbours marked, overlaps counted once."""

    def covered(pos: Column) -> Column:
        step = lambda acc, i: acc + F.least(F.lit(3), F.coalesce(F.get(pos, i + 1) - F.get(pos, i), F.lit(3)))
        return F.when(F.size(pos) == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(pos) - 1), F.lit(0), step))

    def marked(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["key"] == F.get(s, j)["key"], F.lit(False))
        dup = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return let(F.sort_array(F.transform(dup, lambda i: F.get(s, i)["pos"])), covered)

    def sorted_windows(keys: Column) -> Column:
        zipped = F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("pos")))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(F.sort_array(zipped), marked))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(words, lambda w: let(windows(w), sorted_windows)))


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NON_SPACE}+"))


def line_verdict(line: Column, n: Column) -> Column:
    """Name of the first rule that a line of n words fails, or null. Lines without words pass."""
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    return (
        F.when(n == 0, F.lit(None).cast("string"))
        .when(F.regexp_count(line, F.lit(r"[|»>•]")) * 5 >= n + 4, F.lit("navigation"))
        .when(F.regexp_count(line, F.lit("!!")) * 10 > n * 3, F.lit("punctuation"))
        .when(symbols * 2 > n, F.lit("symbols"))
        .when((n >= MIN_PROSE_WORDS) & ~line.rlike(SENTENCE_MARK), F.lit("punctuation"))
        .when((n <= 20) & F.lower(line).rlike(BOILERPLATE), F.lit("boilerplate"))
    )


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_kept: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the id, base statistics, verdict and cleaned text.

    A null text counts as empty and fails the base rule; repeated rows and ids each get their own row; an empty table
    gives an empty table; other columns are not read, so their names can't clash; those named in `carry` come along in the struct `carried`. Texts of any length are read whole.
    A document is kept if it passes the base rule and its lines that pass hold at least `min_kept` of its words.
    """
    text = F.col("_t")
    extra = [F.struct(*carry).alias("carried")] if carry else []
    out = docs.select(F.col(id_col), text_of(text_col).alias("_t"), *extra)
    extra = ["carried"] if carry else []
    out = out.withColumn("_w", words_of(text)).withColumn("_l", F.split(text, "\n", -1))
    out = out.withColumn("_l", F.transform("_l", lambda x: F.struct(x.alias("line"), words_in(x).alias("n"))))  # counted once for all rules
    lines = F.filter("_l", lambda x: x["n"] > 0)["line"]
    out = out.select(
        id_col,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).cast("long").alias("n_repeat_words"),
        F.filter("_l", lambda x: line_verdict(x["line"], x["n"]).isNull()).alias("_kept"),
        F.size("_l").alias("_n_lines"),
        *extra,
    )
    out = out.withColumn("words_kept", F.aggregate("_kept", F.lit(0), lambda a, x: a + x["n"]).cast("long"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & (F.col("words_kept") >= F.lit(min_kept) * F.col("n_words"))).alias("kept"),
        "words_kept",
        (F.col("_n_lines") - F.size("_kept")).cast("long").alias("lines_removed"),
        F.array_join("_kept.line", "\n").alias("clean_text"),
        *extra,
    )


def sql(table: str = "documents") -> str:
    """DuckDB SQL for the query op9."""
    n = "len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))"
    cnt = lambda pat: f"len(regexp_extract_all(x, '{pat}'))"
    sym = "(length(x) - length(translate(x, '#*$%&|<>', '')))"
    ok = (
        f"({n} = 0 OR NOT ({cnt('[|»>•]')} * 5 >= {n} + 4 OR {cnt('!!')} * 10 > {n} * 3 OR {sym} * 2 > {n}"
        f" OR ({n} >= {MIN_PROSE_WORDS} AND NOT regexp_matches(x, '{SENTENCE_MARK}')) OR ({n} <= 20 AND regexp_matches(lower(x), '{BOILERPLATE}'))))"
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, string_split(t, chr(10)) AS l FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY rid),
s AS (SELECT w.rid, doc_id, len(w) AS n_words, list_filter(l, lambda x: {n} > 0) AS ll,
 length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
 length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, coalesce(rep.n, 0) AS n_repeat_words,
 list_filter(l, lambda x: {ok}) AS kl, len(l) AS nl FROM w LEFT JOIN rep ON rep.rid = w.rid),
f AS (SELECT *, coalesce(list_sum(list_transform(kl, lambda x: {n})), 0) AS words_kept, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
 CAST(len(ll) - len(list_distinct(ll)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
 NOT base_failed AND words_kept >= 0.5 * n_words AS kept, CAST(words_kept AS BIGINT) AS words_kept, CAST(nl - len(kl) AS BIGINT) AS lines_removed
FROM f"""

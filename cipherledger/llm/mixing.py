"""Mixing to target weights: iterative proportional fitting of token weights to source, language and topic marginals.

Tokens are summed per cell (source x language x topic); categories without a target of their own share the last
one, so the number of cells is bounded by the targets and not by the data. Each document's inclusion probability
comes from its cell's calibrated weight; a hash of its id decides, so the sample is the same on every run.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, stored, text_of

OTHER = "other"
#: Production targets: shares of tokens.
SOURCES = {"src0": 0.25, "src1": 0.05, "src2": 0.05, OTHER: 0.65}
LANGS = {"en": 0.56, "de": 0.16, "fr": 0.16, "es": 0.11, OTHER: 0.01}
TOPICS = {"licence": 0.04, "contact": 0.02, OTHER: 0.94}
#: Topic of a text: the first whose pattern occurs.
TOPIC_RULES = (("licence", "licen[cs]ed under|under the mit licen[cs]e|all rights reserved"), ("contact", "[a-z0-9._]+@[a-z0-9-]+[.][a-z]+"))
ROUNDS = 12


def topic_of(text: Column) -> Column:
    out = F.lit(OTHER)
    for name, pattern in reversed(TOPIC_RULES):
        out = F.when(F.lower(text).rlike(pattern), F.lit(name)).otherwise(out)
    return out


def rake(cells: list[tuple[tuple[str, str, str], float]], targets: list[Mapping[str, float]], rounds: int = ROUNDS) -> dict[tuple[str, str, str], float]:
    """Weights of cells after `rounds` passes over the three marginals. A category without tokens is left out and the others share its target."""
    w = {k: float(v) for k, v in cells}
    for _ in range(rounds):
        for axis, target in enumerate(targets):
            sums: dict[str, float] = {}
            for k, v in w.items():
                sums[k[axis]] = sums.get(k[axis], 0.0) + v
            whole = sum(t for c, t in target.items() if sums.get(c, 0.0) > 0)
            w = {k: v * (target[k[axis]] / whole) / sums[k[axis]] if sums[k[axis]] > 0 and whole > 0 else 0.0 for k, v in w.items()}
    return w


def mix_sources(docs: DataFrame, sources: Mapping[str, float] = SOURCES, langs: Mapping[str, float] = LANGS, topics: Mapping[str, float] = TOPICS, rate: float | None = None, seed: str = "mix", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The input rows (or their columns `keep`) with n_words, cell columns, weight, probability and selected appended under the prefix `mix_`.

    The weight of a cell is its calibrated share over its share of tokens; probability = min(1, scale x weight), the
    scale being such that the least weight above 0 in demand stays whole: rate / greatest weight, or with rate None
    the largest scale at which no probability passes 1. Texts without words belong to their cell and weigh nothing in
    it; null source, lang or text count as `other`, `other` and empty; repeated ids share their fate; an empty
    table gives an empty one. Columns of the input keep their values; a clashing `mix_` column is replaced. Texts are
    counted whole; where `keep` leaves them out they are read once, as the counts are stored.
    """
    known = lambda c, t: F.when(F.col(c).isin(*[k for k in t if k != OTHER]), F.col(c)).otherwise(F.lit(OTHER))
    cols = [c for c in keep or docs.columns if not c.startswith("mix_")]
    x = docs.select(
        *[F.col(f"`{c}`") for c in cols],
        F.regexp_count(text_of("text"), F.lit(f"{NON_SPACE}+")).cast("long").alias("mix_tokens"),
        known("source", sources).alias("mix_source"),
        known("lang", langs).alias("mix_lang"),
        topic_of(text_of("text")).alias("mix_topic"),
    )
    if "text" not in cols:
        x = stored(x, "mix-counts")
    axes = ["mix_source", "mix_lang", "mix_topic"]
    sums = x.groupBy(*axes).agg(F.sum("mix_tokens").alias("n")).collect()  # at most one row for each combination of targets
    cells = sorted(((r[0], r[1], r[2]), float(r["n"])) for r in sums)
    total = sum(v for _, v in cells)
    w = rake(cells, [sources, langs, topics])
    ratio = {k: (w[k] * total / v if v > 0 else 0.0) for k, v in cells}
    top = max(ratio.values(), default=0.0)
    scale = (rate or 1.0) / top if top > 0 else 0.0
    key = F.concat_ws("|", *axes)
    flat = [y for k, v in ratio.items() for y in (F.lit("|".join(k)), F.lit(v))]
    weight = F.coalesce(F.element_at(F.create_map(*flat), key), F.lit(0.0)) if flat else F.lit(0.0)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    x = x.withColumn("mix_weight", weight).withColumn("mix_probability", F.least(F.lit(1.0), F.col("mix_weight") * scale))
    return x.withColumn("mix_selected", draw < F.col("mix_probability"))


def digest(mixed: DataFrame) -> DataFrame:
    """Columns of the query op4."""
    return mixed.select("doc_id", F.col("mix_tokens").alias("n_words"), F.col("mix_topic").alias("topic"), F.round("mix_weight", 6).alias("weight"), F.round("mix_probability", 6).alias("probability"), F.col("mix_selected").alias("selected"))


def sql(table: str = "documents", columns: str | None = None) -> str:
    """DuckDB SQL for the query op4, or with `columns` for other columns of the documents that are selected."""
    case = lambda c, t: f"CASE WHEN {c} IN ({', '.join(repr(k) for k in t if k != OTHER)}) THEN {c} ELSE '{OTHER}' END"
    topic = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(text, '')), '{p}') THEN '{n}'" for n, p in TOPIC_RULES) + f" ELSE '{OTHER}' END"
    ctes = [
        f"mx AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_words, {case('source', SOURCES)} AS a0, {case('lang', LANGS)} AS a1, {topic} AS a2 FROM {table})",
        "mw_0 AS (SELECT a0, a1, a2, CAST(sum(n_words) AS DOUBLE) AS w FROM mx GROUP BY ALL)",
    ]
    for axis, t in enumerate((SOURCES, LANGS, TOPICS)):
        ctes.append(f"mt_{axis} AS MATERIALIZED (SELECT c, t / (sum(t) OVER ()) AS t FROM (VALUES {', '.join(f'({k!r}, CAST({v} AS DOUBLE))' for k, v in t.items())}) v(c, t) WHERE c IN (SELECT a{axis} FROM mw_0 WHERE w > 0))")
    n = 0
    for _ in range(ROUNDS):
        for axis in range(3):
            ctes.append(f"mw_{n + 1} AS MATERIALIZED (SELECT a0, a1, a2, coalesce(w * t / nullif(sum(w) OVER (PARTITION BY a{axis}), 0), 0) AS w FROM mw_{n} LEFT JOIN mt_{axis} ON c = a{axis})")
            n += 1
    ctes.append(f"mr AS (SELECT f.a0, f.a1, f.a2, CASE WHEN s.w > 0 THEN f.w * (SELECT sum(w) FROM mw_0) / s.w ELSE 0 END AS weight FROM mw_{n} f JOIN mw_0 s ON f.a0 = s.a0 AND f.a1 = s.a1 AND f.a2 = s.a2)")
    ctes.append("mz AS (SELECT mx.*, weight, coalesce(least(1.0, weight / nullif((SELECT max(weight) FROM mr), 0)), 0) AS probability, CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 AS draw FROM mx JOIN mr USING (a0, a1, a2))")
    tail = f"SELECT {columns} FROM mz WHERE draw < probability" if columns else "SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, a2 AS topic, round(weight, 6) AS weight, round(probability, 6) AS probability, draw < probability AS selected FROM mz"
    return "WITH " + ",\n".join(ctes) + "\n" + tail

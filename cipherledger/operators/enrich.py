"""Enrichment of ambiguous findings by an outside responder, whose answers are a table: gate, requests, cache, answers, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import rules as R
from .extract import cache_key, scrubbed, stripped, truncate, validate_response

#: Days for which a stored answer serves.
TTL_DAYS = 7


def ambiguous() -> Column:
    """Purpose unknown, found by a rule, and with a snippet that can be sent."""
    return (F.col("purpose") == "unknown") & (F.col("finding_type") == "deterministic") & (F.coalesce(F.length("snippet"), F.lit(0)) > 0)


def requests(assets: DataFrame, version: str = "v1") -> DataFrame:
    """(seq, snippet, cache_key, redactions, injections, truncated) of the ambiguous assets: secrets and injections out, cut, keyed."""
    x = assets.filter(ambiguous()).select("seq", scrubbed(F.col("snippet")).alias("_a"))
    x = x.select("seq", "_a", stripped(F.col("_a.t")).alias("_b"))
    cut, long = truncate(F.col("_b.t"))
    x = x.select("seq", cut.alias("snippet"), F.col("_a.n").alias("redactions"), F.col("_b.n").alias("injections"), long.alias("truncated"))
    return x.withColumn("cache_key", cache_key(F.col("snippet"), version))


def cached(asked: DataFrame, responses: DataFrame, as_of: str, days: int = TTL_DAYS) -> DataFrame:
    """Requests with the newest answer to their key that is young enough and sound JSON; raw is null for a miss.

    Answers are cut to one a key before the join, so a key that is asked often meets one row.
    """
    young = responses.filter((F.col("stored_at") <= F.to_timestamp(F.lit(as_of))) & (F.col("stored_at") > F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {days} DAYS")))
    sound = young.filter(F.try_parse_json("raw").isNotNull())
    best = sound.groupBy("cache_key").agg(F.max_by("raw", F.struct("stored_at", "raw")).alias("raw"))
    return asked.join(best, "cache_key", "left").withColumn("hit", F.col("raw").isNotNull())


def to_send(asked: DataFrame) -> DataFrame:
    """The distinct requests that the cache doesn't answer."""
    return asked.filter("NOT hit").select("cache_key", "snippet").dropDuplicates(["cache_key"])


def apply(assets: DataFrame, answers: DataFrame, version: str = "v1") -> DataFrame:
    """Assets with the purpose and the confidence of a sound answer, marked as enriched; all others keep what they have.

    answers: (seq, raw). A `reason` says why an answer was rejected.
    """
    field = lambda k: F.get_json_object("raw", f"$.{k}")
    x = assets.join(answers.select("seq", "raw"), "seq", "left").withColumn("reason", F.when(ambiguous() & F.col("raw").isNotNull(), validate_response(F.col("raw"))))
    good = ambiguous() & F.col("raw").isNotNull() & F.col("reason").isNull()
    conf = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), field("confidence").try_cast("double"))), 4)
    x = x.withColumn("_good", good)
    out = {
        "purpose": F.when(F.col("_good"), field("purpose")).otherwise(F.col("purpose")),
        "confidence": F.when(F.col("_good"), conf).otherwise(F.col("confidence")),
        "finding_type": F.when(F.col("_good"), "llm_enriched").otherwise(F.col("finding_type")),
        "llm_prompt_version": F.when(F.col("_good"), F.lit(version)),
        "low_confidence": F.col("_good") & (conf < R.LOW_CONFIDENCE),
    }
    return x.withColumns(out).drop("_good", "raw")


def batch_stats(asked: DataFrame, enriched: DataFrame) -> DataFrame:
    """One row: assets, those left alone, enriched and failed ones, cache hits, attempts, and the rate of success (1 without attempts)."""
    n = enriched.agg(F.count("*").alias("total"), F.count_if(F.col("llm_prompt_version").isNotNull()).alias("enriched"))
    a = asked.agg(F.count("*").alias("attempted"), F.count_if("hit").alias("cache_hits"))
    x = n.crossJoin(F.broadcast(a)).withColumn("failed", F.col("attempted") - F.col("enriched")).withColumn("skipped", F.col("total") - F.col("attempted"))
    return x.withColumn("success_rate", F.when(F.col("attempted") == 0, 1.0).otherwise(F.round(F.col("enriched") / F.col("attempted"), 4)))

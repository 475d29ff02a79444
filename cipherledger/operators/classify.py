"""Rule-driven classification, sensitivity, criticality, lifecycle and ownership, compiled to expressions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import rules as R


#: Results that a rule may give.
VOCABULARY = {"classification": ("infrastructure", "application"), "sensitivity": ("public", "internal", "confidential", "high", "critical"), "criticality": ("low", "medium", "high", "critical")}
#: Letters of a path criterion that rules are found by.
GRAM = 3


def predicate(rule: tuple) -> Column:
    """All criteria present must hold; the entries of one criterion are alternatives."""
    surfaces, purposes, prefixes, paths, classified = rule[:5]
    below, least = rule[7:9] if len(rule) > 7 else (None, None)
    up, low = F.upper("algorithm"), F.lower("file_path")
    any_of = lambda xs: reduce(lambda a, b: a | b, xs)
    parts = []
    if surfaces:
        parts.append(F.col("source_surface").isin(*surfaces))
    if purposes:
        parts.append(F.col("purpose").isin(*purposes))
    if prefixes:
        parts.append(any_of([up.startswith(p) for p in prefixes]))
    if paths:
        parts.append(any_of([low.contains(p) for p in paths]))
    if classified:
        parts.append(F.col("classification") == classified)
    if below is not None:  # a key size that isn't known fails both tests
        parts.append(F.col("key_size_bits") < below)
    if least is not None:
        parts.append(F.col("key_size_bits") >= least)
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def first_match(table: tuple, fallback: str) -> tuple[Column, Column]:
    """Result and description of the first rule that holds."""
    value, why = F.lit(fallback), F.lit("fallback")
    for rule in reversed(table):
        p = predicate(rule)
        value, why = F.when(p, F.lit(rule[5])).otherwise(value), F.when(p, F.lit(rule[6])).otherwise(why)
    return value, why


def classify(assets: DataFrame, tables: Mapping[str, tuple] | None = None) -> DataFrame:
    """Adds classification, sensitivity, criticality and the rule behind each. One pass, no join, no shuffle.

    tables: rules of load_classification() by the name of the column that they decide, in place of the built-in ones.
    """
    for name, builtin in (("classification", R.CLASSIFICATION), ("sensitivity", R.SENSITIVITY), ("criticality", R.CRITICALITY)):
        table = (tables or {}).get(name, builtin)
        if "key_size_bits" not in assets.columns and any(len(rule) > 7 and (rule[7] is not None or rule[8] is not None) for rule in table):
            assets = assets.withColumn("key_size_bits", F.lit(None).cast("int"))
        value, why = first_match(table, R.FALLBACK[name])
        allowed = VOCABULARY[name]
        assets = assets.withColumns({name: checked(value, allowed, R.FALLBACK[name]), f"{name}_rule": F.when(value.isin(*allowed), why).otherwise("invalid rule result")})
    return assets


def checked(value: Column, allowed: tuple[str, ...], fallback: str) -> Column:
    """A rule result outside the vocabulary falls back."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(fallback))


def certificate_stage(days_left: Column) -> Column:
    """Lifecycle of a certificate by whole days to expiry."""
    return F.when(days_left.isNull(), "unknown").when(days_left < 0, "expired").when(days_left <= R.ROTATION_DAYS, "rotation_pending").otherwise("active")


def days_to(expiry: Column, as_of: Column) -> Column:
    return F.floor((expiry.cast("double") - as_of.cast("double")) / 86400)


def algorithm_stage() -> Column:
    up = F.upper("algorithm")
    return F.when(reduce(lambda a, b: a | b, [up.startswith(p) for p in R.LEGACY]), "legacy").otherwise("active")


def assign_owners(assets: DataFrame, owner_rules: DataFrame) -> DataFrame:
    """Owner by the first rule that fits, priority descending then id ascending; null criteria fit all. An owner that is there stays.

    Rules are a user's table of any size. Of rules with the same criteria only the first can decide, so the others go.
    Each rule is found by one criterion that it has: all beginnings of the algorithm, else three letters of the path,
    else surface or purpose. That key is joined by equality with the keys of the distinct (surface, purpose, algorithm,
    path), and what meets is tested whole; no side is broadcast by force.
    """
    cols = ["source_surface", "purpose", "algorithm", "file_path"]
    kinds = assets.select(*[F.col(c).alias(f"_{c}") for c in cols]).distinct()
    up, low = F.upper("_algorithm"), F.lower("_file_path")
    begun = F.transform(F.sequence(F.lit(0), F.coalesce(F.length(up), F.lit(-1))), lambda n: F.concat(F.lit("a:"), F.substring(up, F.lit(1), n)))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - GRAM + 1, F.lit(1))), lambda i: F.concat(F.lit("p:"), F.substring(low, i, F.lit(GRAM))))
    none = F.array().cast("array<string>")
    keys = F.concat(F.when(up.isNull(), none).otherwise(begun), F.coalesce(F.array_distinct(grams), none), F.array(F.concat(F.lit("s:"), "_source_surface"), F.concat(F.lit("q:"), "_purpose"), F.lit("*")))
    r = owner_rules.select("id", F.col("owner").alias("rule_owner"), "priority", "surface", F.col("purpose").alias("rule_purpose"), F.upper("algorithm_prefix").alias("prefix"), F.lower("path_contains").alias("part"))
    alike = ["surface", "rule_purpose", "prefix", "part"]
    r = r.groupBy(*alike).agg(F.max_by(F.struct("id", "rule_owner", "priority"), F.struct("priority", -F.col("id"))).alias("r")).select(*alike, "r.*")
    key = F.when(F.col("prefix").isNotNull(), F.concat(F.lit("a:"), "prefix")).when(F.length("part") >= GRAM, F.concat(F.lit("p:"), F.substring("part", 1, GRAM))).when(F.col("surface").isNotNull(), F.concat(F.lit("s:"), "surface")).when(F.col("rule_purpose").isNotNull(), F.concat(F.lit("q:"), "rule_purpose")).otherwise("*")
    fits = (
        (F.col("surface").isNull() | (F.col("surface") == F.col("_source_surface")))
        & (F.col("rule_purpose").isNull() | (F.col("rule_purpose") == F.col("_purpose")))
        & (F.col("prefix").isNull() | up.startswith(F.col("prefix")))
        & (F.col("part").isNull() | low.contains(F.col("part")))
    )
    kinds = kinds.withColumn("_key", F.explode(keys))
    r = r.withColumn("_key", key)
    best = kinds.join(r, "_key").filter(fits).groupBy(*[f"_{c}" for c in cols]).agg(F.max_by("rule_owner", F.struct("priority", -F.col("id"))).alias("_owner"))
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols])
    own = F.nullif(F.trim("owner"), F.lit("")) if "owner" in assets.columns else F.lit(None).cast("string")
    kept = [F.col(c) for c in assets.columns if c != "owner"]
    return assets.join(best, same, "left").select(*kept, F.coalesce(own, F.col("_owner")).alias("owner"))


def list_owner_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.col("priority").desc(), "id")


def add_owner_rule(rules: DataFrame, owner: str, priority: int, surface: str | None = None, purpose: str | None = None, algorithm_prefix: str | None = None, path_contains: str | None = None) -> DataFrame:
    if not owner.strip():
        raise ValueError("owner is empty")
    if surface is not None and surface not in R.SURFACES:
        raise ValueError(f"unknown surface {surface}")
    new = rules.sparkSession.createDataFrame([(owner.strip(), priority, surface, purpose, algorithm_prefix, path_contains)], "owner string, priority int, surface string, purpose string, algorithm_prefix string, path_contains string")
    top = rules.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    return rules.unionByName(new.crossJoin(top).withColumn("id", F.col("_top") + 1).drop("_top").select(*rules.columns))


def delete_owner_rule(rules: DataFrame, rule_id: int) -> DataFrame:
    return rules.filter(F.col("id") != rule_id)

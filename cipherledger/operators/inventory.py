"""Inventory: deduplication, families, groups, statistics and lookups of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.rules import FAMILIES


def dedup_key(algorithm: str = "algorithm", purpose: str = "purpose", path: str = "file_path", line: str = "line_number") -> Column:
    """First 16 hex digits of SHA-256 over upper(algorithm)|purpose|path|line; a null line counts as empty."""
    return F.substring(F.sha2(F.concat_ws("|", F.upper(algorithm), F.col(purpose), F.col(path), F.coalesce(F.col(line).cast("string"), F.lit(""))), 256), 1, 16)


def deduplicate(findings: DataFrame) -> DataFrame:
    """One row per key: greatest confidence, ties to the earliest seq; with n_observed and first_seq.

    A partial aggregate per key runs before the only shuffle, so a key with many observations is no hot spot.
    """
    row = F.struct(*findings.columns)
    best = findings.withColumn("dedup_key", dedup_key()).groupBy("dedup_key")
    out = best.agg(F.max_by(row, F.struct(F.col("confidence"), -F.col("seq"))).alias("r"), F.count("*").alias("n_observed"), F.min("seq").alias("first_seq"))
    return out.select("dedup_key", "r.*", "n_observed", "first_seq")


#: What a winner takes over from the records that it displaced where it has none of its own; the first column of a group says whether it has.
BLANKS = (
    ("priority", "urgency_flag", "hndl_flag", "x_years", "y_years", "z_years"),
    ("rec_kind", "rec_replacement", "rec_path", "rec_path_type", "rec_status", "rec_alternative", "rec_protocols"),
    ("owner",),
    ("reachable",),
    ("reachability_path",),
)
COUNTS = ("dedup_key", "n_observed", "first_seq")


def levels(findings: DataFrame) -> DataFrame:
    """The first record of each key at each confidence, with n_observed and first_seq: no other can displace one or be displaced.

    Partial sums run before the shuffle, and the rows of two tables merge by merge_levels(), so a key with a third of all
    observations is no hot spot. A null confidence is the lowest. Of records with equal seq and confidence any one is taken.
    Those partial sums sort whole rows, so rows are dealt out by seq first: a task sorts a shuffle partition, not all rows of a large input split.
    """
    row = F.struct(*findings.columns)
    out = findings.repartition("seq").withColumn("dedup_key", dedup_key()).groupBy("dedup_key", F.coalesce("confidence", F.lit(-1.0)).alias("_level")).agg(F.min_by(row, "seq").alias("r"), F.count("*").alias("n_observed"), F.min("seq").alias("first_seq"))
    return out.select("dedup_key", "r.*", "n_observed", "first_seq")


def merge_levels(a: DataFrame, b: DataFrame) -> DataFrame:
    """levels() of the findings behind both tables together."""
    both = a.unionByName(b, allowMissingColumns=True)
    row = F.struct(*[c for c in both.columns if c not in COUNTS])
    out = both.groupBy("dedup_key", F.coalesce("confidence", F.lit(-1.0)).alias("_level")).agg(F.min_by(row, "seq").alias("r"), F.sum("n_observed").alias("n_observed"), F.min("first_seq").alias("first_seq"))
    return out.select("dedup_key", "r.*", "n_observed", "first_seq")


def winners(first: DataFrame, blanks: tuple[tuple[str, ...], ...] = BLANKS) -> DataFrame:
    """Deduplicated rows of levels(): greatest confidence, ties to the earliest seq, and blanks filled from what they displaced.

    A record displaces the one before it where its confidence is greater, and takes over what it lacks; a record that
    displaces nothing gives nothing. That is a fold over the levels of a key in order of seq. A key has as many levels
    as different confidences, which rules bound; only their blanks are gathered, not their rows. Groups of `blanks`
    whose first column is absent are left out.
    """
    groups = [[c for c in g if c in first.columns] for g in blanks if g[0] in first.columns]
    row = F.struct(*[c for c in first.columns if c not in COUNTS])
    own = [F.when(F.col(g[0]).isNotNull(), F.struct(*g)).alias(f"b{i}") for i, g in enumerate(groups)]
    level = F.coalesce("confidence", F.lit(-1.0)).cast("double").alias("level")
    out = first.groupBy("dedup_key").agg(
        F.max_by(row, F.struct(F.coalesce("confidence", F.lit(-1.0)), -F.col("seq"))).alias("r"),
        F.sum("n_observed").alias("n_observed"),
        F.min("first_seq").alias("first_seq"),
        *([F.array_sort(F.collect_list(F.struct(F.col("seq").alias("at"), level, *own))).alias("_steps")] if groups else []),
    )
    if not groups:
        return out.select("dedup_key", "r.*", "n_observed", "first_seq")
    taken = lambda acc, x: F.struct(x["at"].alias("at"), x["level"].alias("level"), *[F.coalesce(x[f"b{i}"], acc[f"b{i}"]).alias(f"b{i}") for i in range(len(groups))])
    out = out.withColumn("_last", F.aggregate(F.slice("_steps", 2, F.greatest(F.size("_steps") - 1, F.lit(0))), F.get("_steps", F.lit(0)), lambda acc, x: F.when(x["level"] > acc["level"], taken(acc, x)).otherwise(acc)))
    filled = {c: F.col(f"_last.b{i}.{c}") for i, g in enumerate(groups) for c in g}
    return out.select("dedup_key", *[filled[c].alias(c) if c in filled else F.col(f"r.{c}") for c in first.columns if c not in COUNTS], "n_observed", "first_seq")


def merge_blanks(findings: DataFrame, columns: list[str]) -> DataFrame:
    """Winners of deduplication with blanks in `columns` filled from the records they displaced, latest first."""
    return winners(levels(findings), tuple((c,) for c in columns))


def family_of(algorithm: Column) -> Column:
    """Family of an algorithm: the first that equals it or prefixes it before a dash; else the name itself."""
    up = F.upper(F.coalesce(algorithm, F.lit("")))
    out = algorithm
    for f in reversed(FAMILIES):
        out = F.when((up == f) | up.startswith(f"{f}-"), F.lit(f)).otherwise(out)
    return out


def family_groups(findings: DataFrame, top: int = 50) -> DataFrame:
    """Groups by family, purpose and surface: observations, spellings with counts, locations and the first `top` of them.

    Locations are ranked inside each group before they are gathered, so a group never holds more than `top`.
    """
    keys = ["family", "purpose", "source_surface"]
    x = findings.withColumn("family", family_of(F.col("algorithm")))
    variants = x.groupBy(*keys, "algorithm").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sum("n").alias("observation_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("algorithm", "n")))).alias("variants"))
    places = x.groupBy(*keys, "file_path", "line_number").agg(F.count("*").alias("n"))
    count = places.groupBy(*keys).agg(F.count("*").alias("location_count"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("file_path", "line_number"))
    first = places.withColumn("_r", rank).filter(F.col("_r") <= top).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(":", "file_path", F.col("line_number").cast("string")).alias("at")))).alias("_f"))
    first = first.select(*keys, F.col("_f.at").alias("locations"))
    return variants.join(count, keys).join(first, keys)


def stats(findings: DataFrame) -> DataFrame:
    """One row: total, unique, duplicates and their rate to 4 places."""
    n = findings.groupBy(dedup_key().alias("k")).agg(F.count("*").alias("n"))
    out = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("unique_assets"))
    dup = F.col("total") - F.col("unique_assets")
    return out.select("total", "unique_assets", dup.alias("duplicates"), F.round(F.when(F.col("total") > 0, dup / F.col("total")).otherwise(0.0), 4).alias("duplicate_rate"))


def counts_by_first_spelling(findings: DataFrame) -> DataFrame:
    """Unique assets by the algorithm as first ingested, and purpose."""
    first = findings.groupBy(dedup_key().alias("k")).agg(F.min_by("algorithm", "seq").alias("algorithm"), F.first("purpose").alias("purpose"))
    return first.groupBy("algorithm", "purpose").agg(F.count("*").alias("n"))


def in_order(assets: DataFrame) -> DataFrame:
    return assets.orderBy("file_path", F.coalesce("line_number", F.lit(0)), "first_seq")


def by_algorithm(assets: DataFrame, prefix: str) -> DataFrame:
    return assets.filter(F.upper("algorithm").startswith(prefix.upper()))


def by_purpose(assets: DataFrame, purpose: str) -> DataFrame:
    return assets.filter(F.col("purpose") == purpose)


def by_file(assets: DataFrame, path: str) -> DataFrame:
    return assets.filter(F.replace("file_path", F.lit("\\"), F.lit("/")) == path.replace("\\", "/"))


def union_surfaces(parts: dict[str, DataFrame], order: tuple[str, ...] = ("source_code", "certificate", "binary", "container", "infrastructure")) -> DataFrame:
    """Findings of all surfaces in one table; `surface_ord` keeps the surfaces' order."""
    out = None
    for k, s in enumerate(order):
        if s in parts:
            x = parts[s].withColumn("source_surface", F.lit(s)).withColumn("surface_ord", F.lit(k))
            out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def scanned_surfaces(findings: DataFrame) -> DataFrame:
    """One row with the surfaces seen; source code always counts."""
    return findings.agg(F.array_sort(F.array_union(F.collect_set("source_surface"), F.array(F.lit("source_code")))).alias("surfaces"))

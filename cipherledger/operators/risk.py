"""Quantum risk (x + y > z), recommendations and migration impact. Rule lookups compile to expressions; no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import rules as R


def _ordered(entries: list[tuple[str, str | None, object]], bonus: int) -> list[tuple[str, str | None, object]]:
    """Entries best first: pattern length plus the bonus for a stated purpose; ties keep their order."""
    return sorted(entries, key=lambda e: -(len(e[0]) + (bonus if e[1] else 0)))


def _lookup(entries: list[tuple[str, str | None, object]], bonus: int, default: Column) -> Column:
    """Value of the best entry that fits. Entries are an array that is searched, not a branch each: code of many branches outgrows what the JVM compiles."""
    rows = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).cast("string").alias("q"), F.lit(v).alias("v")) for p, q, v in _ordered(entries, bonus)])
    fits = lambda a, e: ((e["p"] == "") | F.coalesce(a["up"].startswith(e["p"]), F.lit(False))) & (e["q"].isNull() | F.coalesce(e["q"] == a["purpose"], F.lit(False)))
    asset = F.array(F.struct(F.upper("algorithm").alias("up"), F.col("purpose").alias("purpose")))  # one item: worked out once, not for each entry
    found = F.transform(asset, lambda a: F.get(F.filter(rows, lambda e: fits(a, e)), F.lit(0))["v"])
    return F.coalesce(F.get(found, F.lit(0)), default)


def fixed(value: Column, digits: int) -> Column:
    """A number with so many digits behind the point, rounded by its exact binary value."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * digits))


def mapping_ord() -> Column:
    """Row of the best replacement mapping, or null: longest pattern that prefixes the algorithm among those of its purpose."""
    return _lookup([(m[0], m[1], i) for i, m in enumerate(R.MAPPINGS)], 1000, F.lit(None).cast("int"))


def best_rows(assets: DataFrame, table: DataFrame, pattern: str, purpose: str, any_purpose: str, bonus: int) -> DataFrame:
    """(_algorithm, _purpose, _best): the `ord` of the best row of a user's table for each pair of the assets.

    A row fits where its pattern, in upper case, begins the algorithm (* always) and its purpose is the asset's or
    any_purpose; the score is the pattern's length, and the bonus for a purpose of its own; ties go to the first row. All
    beginnings of the distinct algorithms are joined by equality, so neither side is broadcast by force nor looped over.
    """
    kinds = assets.select(F.col("algorithm").alias("_algorithm"), F.col("purpose").alias("_purpose")).distinct()
    up = F.upper("_algorithm")
    begun = kinds.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(0), F.coalesce(F.length(up), F.lit(0))), lambda n: F.substring(up, F.lit(1), n))))
    rows = table.select(F.when(F.col(pattern) == "*", "").otherwise(F.upper(pattern)).alias("_p"), F.lower(purpose).alias("_q"), F.col("ord").alias("_o"))
    own = F.coalesce(F.col("_q") != any_purpose, F.lit(False))
    hit = begun.join(rows, "_p").filter(~own | (F.col("_q") == F.lower("_purpose")))
    return hit.groupBy("_algorithm", "_purpose").agg(F.max_by("_o", F.struct(F.length("_p") + F.when(own, bonus).otherwise(0), -F.col("_o"))).alias("_best"))


def _joined_best(assets: DataFrame, best: DataFrame, name: str) -> DataFrame:
    same = F.col("algorithm").eqNullSafe(F.col("_algorithm")) & F.col("purpose").eqNullSafe(F.col("_purpose"))
    return assets.join(best, same, "left").drop("_algorithm", "_purpose").withColumnRenamed("_best", name)


def with_mapping(assets: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """Adds the best mapping's columns, of the built-in table (compiled, 26 rows) or of load_mappings()."""
    if mappings is not None:
        return _joined_best(assets, best_rows(assets, mappings, "pattern", "map_purpose", "any", 1000), "mapping_ord").join(mappings.withColumnRenamed("ord", "mapping_ord"), "mapping_ord", "left")
    table = F.broadcast(R.mapping_table(assets.sparkSession).withColumnRenamed("ord", "mapping_ord"))  # 26 rows
    return assets.withColumn("mapping_ord", mapping_ord()).join(table, "mapping_ord", "left")


def x_years(shelf_life: tuple = R.SHELF_LIFE) -> Column:
    best: dict[str, int] = {}
    for c, _, x in shelf_life:
        best[c] = max(best.get(c, 0), x)
    out = F.lit(10)
    for c, x in best.items():
        out = F.when(F.col("classification") == c, F.lit(x)).otherwise(out)
    for c, s, x in shelf_life:
        out = F.when((F.col("classification") == c) & (F.col("sensitivity") == s), F.lit(x)).otherwise(out)
    return out


def y_years() -> Column:
    return _lookup(list(R.MIGRATION_YEARS), 100, F.lit(R.Y_DEFAULT))


def hndl(x: Column, years: int = R.HNDL_YEARS, signature_years: int = R.HNDL_SIGNATURE_YEARS) -> Column:
    return (
        F.when(F.col("purpose").isin("hashing", "mac", "random_generation", "key_derivation"), F.lit(False))
        .when(~F.coalesce("vulnerable", F.lit(True)), F.lit(False))
        .when(F.col("purpose").isin("key_establishment", "encryption"), x >= years)
        .when(F.col("purpose") == "digital_signature", x >= signature_years)
        .otherwise(F.lit(False))
    )


def priority(urgent: Column, harvest: Column) -> Column:
    vulnerable, broken, weakened = F.coalesce("vulnerable", F.lit(True)), F.coalesce("broken", F.lit(False)), F.coalesce("weakened", F.lit(False))
    return F.when(broken, "P1").when(~vulnerable & ~weakened, "P4").when(~vulnerable, "P3").when(urgent & harvest, "P1").when(urgent | harvest, "P2").otherwise("P3")


def reachability_weight() -> Column:
    return F.when(F.col("reachable").isNull(), 0.8).when(F.col("reachable"), 1.0).otherwise(0.5)


def classification_weight() -> Column:
    level = F.col("criticality")
    infra = F.when(level.isin("critical", "high"), 1.0).otherwise(0.9)
    return F.when(F.col("classification") == "infrastructure", infra).when(level == "critical", 1.0).when(level == "high", 0.9).when(level == "medium", 0.7).otherwise(0.5)


def score(assets: DataFrame, z: int = R.Z_DEFAULT, *, mappings: DataFrame | None = None, years: DataFrame | None = None, shelf_life: tuple = R.SHELF_LIFE, harvest: tuple[int, int] = (R.HNDL_YEARS, R.HNDL_SIGNATURE_YEARS)) -> DataFrame:
    """Adds x, y, z, urgency, hndl, priority and weights to classified assets. Columns override_x, override_y and override_z win where set.

    mappings, years, shelf_life, harvest: tables of load_mappings(), load_years(), load_profile() in place of the built-in ones.
    """
    pick = lambda name, value: F.coalesce(F.col(name), value) if name in assets.columns else value
    out = with_mapping(assets, mappings)
    if years is None:
        y = y_years()
    else:
        own = years.select(F.col("ord").alias("_y_ord"), F.col("years").alias("_y"))
        out = _joined_best(out, best_rows(assets, years, "pattern", "migration_type", "*", 100), "_y_ord").join(own, "_y_ord", "left")
        y = F.coalesce("_y", F.lit(R.Y_DEFAULT))
    out = out.withColumns({"x_years": pick("override_x", x_years(shelf_life)), "y_years": pick("override_y", y), "z_years": pick("override_z", F.lit(z))}).drop("_y_ord", "_y")
    out = out.withColumns({"urgency_flag": F.col("x_years") + F.col("y_years") > F.col("z_years"), "hndl_flag": hndl(F.col("x_years"), *harvest)})
    weight = reachability_weight() if "reachable" in assets.columns else F.lit(0.8)
    return out.withColumns({"priority": priority(F.col("urgency_flag"), F.col("hndl_flag")), "reachability_weight": weight, "classification_weight": classification_weight()})


def scenarios(assets: DataFrame, timelines: tuple = R.Z_SCENARIOS) -> DataFrame:
    """Scores under the threat timelines, which are few."""
    z = assets.sparkSession.createDataFrame(list(timelines), "scenario string, override_z int")
    return score(assets.crossJoin(F.broadcast(z)))  # a row for each timeline


def recommend(assets: DataFrame, greenfield: bool = False) -> DataFrame:
    """Adds rec_kind and the recommendation to scored assets."""
    none = F.col("mapping_ord").isNull()
    idle = ~none & ~F.col("vulnerable") & ~F.col("weakened")
    pending = ~none & ~idle & (F.col("status") == "under_standardization")
    unknown = none | pending
    green = F.lit(greenfield) & (F.col("path_type") == "hybrid")
    valid = F.col("path_type").isin("hybrid", "pure_pqc", "classical_upgrade", "no_action")
    status = F.when(F.col("status").isin("standardized", "under_standardization", "classical"), F.col("status")).otherwise("standardized")
    return assets.withColumns(
        {
            "rec_kind": F.when(unknown, "unknown").when(idle, "no_action").otherwise("migrate"),
            "rec_replacement": F.when(unknown, R.UNKNOWN_REPLACEMENT).otherwise(F.col("replacement")),
            "rec_path": F.when(unknown, R.UNKNOWN_PATH).when(~idle & green, F.replace("path", F.lit("hybrid:"), F.lit("pure-pqc:"))).otherwise(F.col("path")),
            "rec_path_type": F.when(unknown, "hybrid").when(idle, "no_action").when(green, "pure_pqc").when(valid, F.col("path_type")).otherwise("hybrid"),
            "rec_status": F.when(unknown, "classical").otherwise(status),
            "rec_alternative": F.when(unknown | idle, F.lit(None)).otherwise(F.col("alternative")),
            "rec_protocols": F.when(unknown | idle, F.lit(None)).otherwise(F.col("protocols")),
        }
    )


def purpose_mismatches(scored: DataFrame) -> DataFrame:
    """Rows whose mapping is for another purpose; empty unless the rule table is broken."""
    return scored.filter(F.col("map_purpose").isNotNull() & (F.col("map_purpose") != "any") & (F.col("map_purpose") != F.col("purpose")))


def impact_ord() -> Column:
    return _lookup([(p, q, i) for i, (p, q, _) in enumerate(R.IMPACTS)], 100, F.lit(len(R.IMPACTS) - 1))


def migration(recommended: DataFrame, *, impacts: DataFrame | None = None, weights: tuple[float, ...] = R.WEIGHTS, step_lists: tuple = R.STEPS) -> DataFrame:
    """Adds factor scores, composite score, level, migration priority, affected components, validation steps and the narrative.

    Columns protocol, library and rec_libraries are used where the table has them. impacts, weights, step_lists: tables of
    load_impacts(), load_weights() and load_steps() in place of the built-in ones; an asset that no impact fits takes
    the built-in scores of any algorithm.
    """
    spark = recommended.sparkSession
    table = F.broadcast(spark.createDataFrame([(i, list(s)) for i, (_, _, s) in enumerate(R.IMPACTS)], "impact_ord int, factor_scores array<double>"))  # 13 rows
    listed = lambda xs: F.array(*[F.lit(x) for x in xs])
    steps = F.create_map(*[v for kind, names in step_lists for v in (F.lit(kind), listed(names))])
    if impacts is None:
        out = recommended.withColumn("impact_ord", impact_ord()).join(table, "impact_ord")
    else:
        own = impacts.select(F.col("ord").alias("impact_ord"), F.array(*[F.element_at("scores", F.lit(f)) for f in R.FACTORS]).alias("_scores"))
        out = _joined_best(recommended, best_rows(recommended, impacts, "prefix", "purpose", "*", 100), "impact_ord").join(own, "impact_ord", "left")
        out = out.withColumn("factor_scores", F.coalesce("_scores", F.array(*[F.lit(v) for v in R.IMPACTS[-1][2]]))).drop("_scores")
    weighted = F.aggregate(F.zip_with("factor_scores", F.array(*[F.lit(w) for w in weights]), lambda a, w: a * w), F.lit(0.0), lambda a, x: a + x)
    composite = F.round(F.least(F.lit(1.0), F.round(weighted, 10)), 4)
    none = F.array().cast("array<string>")
    has = lambda c: F.col(c) if c in recommended.columns else F.lit(None)
    one = lambda c: F.array_compact(F.array(has(c).cast("string")))
    infra = F.array(F.lit("TLS configuration"), F.lit("Certificate infrastructure"))
    parts = F.concat(F.coalesce("rec_protocols", none), F.coalesce(has("rec_libraries").cast("array<string>"), none))
    for more in (one("protocol"), one("library"), F.when(F.col("classification") == "infrastructure", infra).otherwise(none)):
        parts = F.concat(parts, F.array_except(more, parts))
    via = F.concat(F.coalesce(F.concat(F.lit(" via "), has("protocol").cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(" ("), has("library").cast("string"), F.lit(")")), F.lit("")))
    out = out.withColumn("composite", composite).withColumns(
        {
            "impact_level": F.when(F.col("composite") < 0.25, "low").when(F.col("composite") < 0.5, "moderate").when(F.col("composite") < 0.75, "high").otherwise("critical"),
            "migration_priority": F.when(F.col("priority") == "P1", "immediate").when(F.col("priority") == "P2", "near-term").when(F.col("priority") == "P4", "monitor").otherwise("planned"),
            "components": F.when(F.size(parts) > 0, parts).otherwise(F.array(F.concat("source_surface", F.lit(" layer")))),
            "steps": F.coalesce(F.try_element_at(steps, F.col("rec_path_type")), listed(step_lists[0][1])),
            "current_state": F.concat(F.col("algorithm"), F.lit(" used for "), F.replace("purpose", F.lit("_"), F.lit(" ")), F.lit(" at "), F.concat_ws(":", "file_path", F.col("line_number").cast("string")), via),
            "risk_context": F.coalesce(
                F.nullif(
                    F.concat_ws(
                        "; ",
                        F.when(F.col("urgency_flag"), F.concat(F.lit("quantum-urgent (X="), F.col("x_years").cast("string"), F.lit("yr + Y="), F.col("y_years").cast("string"), F.lit("yr > Z="), F.col("z_years").cast("string"), F.lit("yr threat timeline)"))),
                        F.when(F.col("hndl_flag"), F.lit("HNDL exposure: adversaries may already be harvesting ciphertext")),
                    ),
                    F.lit(""),
                ),
                F.concat(F.lit("priority "), F.col("priority"), F.lit(" — migration recommended")),
            ),
            "action": F.concat(F.lit("Migrate to "), F.col("rec_replacement"), F.lit(" ["), F.col("rec_status"), F.lit("] via "), F.coalesce("rec_path", "rec_path_type"), F.lit(" strategy")),
        }
    )
    return out.withColumn(
        "narrative",
        F.concat(
            F.concat_ws(" → ", "current_state", "risk_context", "action", F.concat(F.lit("affects: "), F.array_join("components", " + ")), F.concat(F.lit("migration priority: "), F.col("migration_priority"))),
            F.concat(F.lit(" (impact: "), F.col("impact_level"), F.lit(", composite score: "), fixed(F.col("composite"), 2), F.lit(")")),
        ),
    )


def priority_counts(scored: DataFrame) -> DataFrame:
    """One row: assets, those of the two highest priorities and those with harvest exposure."""
    return scored.agg(F.count("*").alias("total"), F.count_if(F.col("priority") == "P1").alias("p1"), F.count_if(F.col("priority") == "P2").alias("p2"), F.count_if("hndl_flag").alias("hndl"))


def under_standardization(spark: SparkSession) -> DataFrame:
    """Names of algorithms that are still being standardised, in the order of their table."""
    return spark.createDataFrame(list(enumerate(R.UNDER_STANDARDIZATION)), "ord int, name string")


def migration_stats(migrated: DataFrame) -> DataFrame:
    """Counts and mean score by migration priority, over assets with a recommendation."""
    return migrated.filter("rec_kind IS NOT NULL").groupBy("migration_priority").agg(F.count("*").alias("n"), F.round(F.avg("composite"), 4).alias("mean_composite"))

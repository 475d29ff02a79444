"""Rule tables from files that users edit: JSON lines or arrays, checked when they are loaded; without a path the built-in table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import detection as D
from ..plans import rules as R

FINGERPRINT = "rule_id string, pattern string, algorithm string, purpose string, confidence double"
MAPPING = "pattern string, map_purpose string, vulnerable boolean, broken boolean, weakened boolean, replacement string, status string, path_type string, path string, alternative string, protocols array<string>"
CRITERIA = ("surface", "purpose", "algorithm_prefix", "file_path_contains")


def _in_order(df: DataFrame) -> DataFrame:
    """Rows with `ord`, their place in the file; a rule file is read as one partition, being edited by hand."""
    return df.coalesce(1).withColumn("_i", F.monotonically_increasing_id()).withColumn("ord", (F.row_number().over(Window.orderBy("_i")) - 1).cast("int")).drop("_i")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _in_order(spark.read.schema(schema).option("multiLine", True).json(path))


def _sound(rules: DataFrame, problems: DataFrame) -> DataFrame:
    """The table, or an error that names its first problems."""
    found = problems.limit(20).collect()
    if found:
        raise ValueError("; ".join(f"{r['rule_id']}: {r['problem']}" for r in found))
    return rules


def detection_problems(rules: DataFrame) -> DataFrame:
    """(rule_id, problem): what rule_violations() finds, a kind that isn't known, and call rules with values but none given."""
    base = R.rule_violations(rules.withColumn("pattern", F.col("rule_function")))
    bad = F.array_compact(F.array(F.when(F.col("kind").isNull() | ~F.col("kind").isin(*D.KINDS), F.lit("unknown match type")), F.when((F.col("kind") == "call_with_arg") & (F.coalesce(F.size("arg_values"), F.lit(0)) < 1), F.lit("no argument values"))))
    return base.union(rules.select("rule_id", F.explode(bad)))


def load_detection_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Columns of detection.SCHEMA; a file may leave out all but rule_id, language, kind, rule_function, algorithm, purpose and confidence."""
    if path is None:
        return D.detection_table(spark)
    rules = _read(spark, path, D.SCHEMA.split(", ", 1)[1]).withColumn("role", F.coalesce("role", F.lit("any"))).withColumn("language", F.lower("language"))
    return _sound(rules, detection_problems(rules))


def load_patterns(spark: SparkSession, path: str | None = None, builtin: tuple = R.FINGERPRINTS) -> DataFrame:
    """Fingerprint, container or cipher rules with their order: (ord, rule_id, pattern, algorithm, purpose, confidence)."""
    if path is None:
        return R.fingerprint_table(spark, builtin)
    rules = _read(spark, path, FINGERPRINT).select("ord", *[c.split()[0] for c in FINGERPRINT.split(", ")])
    return _sound(rules, R.rule_violations(rules))


def load_classification(spark: SparkSession, path: str) -> tuple[tuple, ...]:
    """Rules of one pass as classify.predicate() takes them, priority descending, equal ones in file order.

    A criterion may be one value or a list. Columns: priority, result, description, the CRITERIA, classification_result,
    key_size_lt, key_size_gte. The file is edited by hand, so its rows come to the driver, where they become expressions.
    """
    kinds = ", ".join(f"{c} variant" for c in CRITERIA)
    raw = _read(spark, path, f"priority int, result string, description string, classification_result string, key_size_lt int, key_size_gte int, {kinds}")
    listed = lambda c: F.coalesce(F.try_variant_get(c, "$", "array<string>"), F.array_compact(F.array(F.try_variant_get(c, "$", "string"))))
    rows = raw.select("priority", "ord", "result", "description", "classification_result", "key_size_lt", "key_size_gte", *[listed(c).alias(c) for c in CRITERIA])
    bad = rows.filter("result IS NULL OR priority IS NULL").select(F.coalesce("description", F.lit("rule")).alias("rule_id"), F.lit("missing field").alias("problem"))
    out = _sound(rows, bad).orderBy(F.col("priority").desc(), "ord").collect()
    some = lambda x: tuple(x) if x else None
    return tuple((some(r.surface), some(r.purpose), some([p.upper() for p in r.algorithm_prefix or ()]), some([p.lower() for p in r.file_path_contains or ()]), r.classification_result, r.result, r.description or "", r.key_size_lt, r.key_size_gte) for r in out)


def load_mappings(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Replacement mappings with their order; a mapping that doesn't say so is vulnerable, neither broken nor weakened, standardised and hybrid."""
    if path is None:
        return R.mapping_table(spark)
    m = _read(spark, path, MAPPING)
    filled = {"vulnerable": True, "broken": False, "weakened": False, "status": "standardized", "path_type": "hybrid"}
    m = m.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in filled.items()}).withColumn("pattern", F.upper("pattern"))
    bad = m.filter("pattern IS NULL OR map_purpose IS NULL OR replacement IS NULL").select(F.coalesce("pattern", F.lit("mapping")).alias("rule_id"), F.lit("missing field").alias("problem"))
    return _sound(m.select("ord", *[c.split()[0] for c in MAPPING.split(", ")]), bad)


def load_years(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(pattern, migration_type, years): shelf life or migration years; * in either stands for any."""
    if path is None:
        return spark.createDataFrame([(i, *r) for i, r in enumerate(R.MIGRATION_YEARS)], "ord int, pattern string, migration_type string, years int")
    y = _read(spark, path, "pattern string, migration_type string, years int")
    bad = y.filter("pattern IS NULL OR years IS NULL OR years < 0").select(F.coalesce("pattern", F.lit("profile")).alias("rule_id"), F.lit("missing or negative years").alias("problem"))
    return _sound(y.select("ord", "pattern", F.coalesce("migration_type", F.lit("*")).alias("migration_type"), "years"), bad)


def load_impacts(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(ord, prefix, purpose, scores map): factor scores of migrations; all factors must be there and lie in [0, 1]."""
    if path is None:
        rows = [(i, p, q, dict(zip(R.FACTORS, s, strict=True))) for i, (p, q, s) in enumerate(R.IMPACTS)]
        return spark.createDataFrame(rows, "ord int, prefix string, purpose string, scores map<string,double>")
    x = _read(spark, path, "prefix string, purpose string, scores map<string,double>").select("ord", "prefix", "purpose", "scores")
    whole = F.forall(F.array(*[F.lit(f) for f in R.FACTORS]), lambda f: F.coalesce(F.try_element_at("scores", f).between(0, 1), F.lit(False)))
    return _sound(x, x.filter(~whole).select(F.coalesce("prefix", F.lit("impact")).alias("rule_id"), F.lit("factor missing or out of range").alias("problem")))


def _unique(x: DataFrame, key: str) -> DataFrame:
    return x.groupBy(key).count().filter("count > 1").select(F.col(key).alias("rule_id"), F.lit("stated twice").alias("problem"))


def load_weights(spark: SparkSession, path: str | None = None) -> tuple[float, ...]:
    """Weights in the order of the factors, from rows (factor, weight); all factors must be there once, in [0, 1]."""
    if path is None:
        return R.WEIGHTS
    x = _read(spark, path, "factor string, weight double")
    bad = x.filter(~F.coalesce(F.col("factor").isin(*R.FACTORS) & F.col("weight").between(0, 1), F.lit(False))).select(F.coalesce("factor", F.lit("weight")).alias("rule_id"), F.lit("unknown factor or weight out of range").alias("problem"))
    given = {r.factor: r.weight for r in _sound(x, bad.union(_unique(x, "factor"))).collect()}
    if missing := [f for f in R.FACTORS if f not in given]:
        raise ValueError(f"no weight for {', '.join(missing)}")
    return tuple(given[f] for f in R.FACTORS)


def load_steps(spark: SparkSession, path: str | None = None) -> tuple:
    """Validation steps by kind of path, from rows (path_type, steps); the first row serves kinds that have none."""
    if path is None:
        return R.STEPS
    x = _read(spark, path, "path_type string, steps array<string>")
    bad = x.filter("path_type IS NULL OR coalesce(size(steps), 0) < 1").select(F.coalesce("path_type", F.lit("steps")).alias("rule_id"), F.lit("missing field").alias("problem"))
    rows = _sound(x, bad.union(_unique(x, "path_type"))).orderBy("ord").collect()
    if not rows:
        raise ValueError("no validation steps")
    return tuple((r.path_type, tuple(r.steps)) for r in rows)


@dataclass(frozen=True)
class Profile:
    """Years that data stay worth reading by (classification, sensitivity), years until the threat, and the years from which harvesting counts."""

    shelf_life: tuple = R.SHELF_LIFE
    z: int = R.Z_DEFAULT
    scenarios: tuple = R.Z_SCENARIOS
    harvest: tuple[int, int] = (R.HNDL_YEARS, R.HNDL_SIGNATURE_YEARS)


def load_profile(spark: SparkSession, path: str | None = None) -> Profile:
    """One profile: {shelf_life: [{classification, sensitivity, years}], threat: {default, name: years}, harvest: {years, signature_years}}; parts left out stay as built in."""
    if path is None:
        return Profile()
    schema = "shelf_life array<struct<classification:string,sensitivity:string,years:int>>, threat map<string,int>, harvest struct<years:int,signature_years:int>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a profile is one object")
    row, base = rows[0], Profile()
    shelf = tuple((s.classification, s.sensitivity, s.years) for s in row.shelf_life) if row.shelf_life else base.shelf_life
    threat = dict(row.threat or {})
    numbers = [x for _, _, x in shelf] + list(threat.values()) + list(row.harvest or ())
    if any(x is None or x < 0 for x in numbers) or any(c is None or s is None for c, s, _ in shelf):
        raise ValueError("a profile's years must be given and not negative")
    z = threat.pop("default", base.z)
    return Profile(shelf, z, tuple(threat.items()) or base.scenarios, tuple(row.harvest) if row.harvest else base.harvest)


@dataclass(frozen=True)
class RuleTables:
    """Tables that a user gives a run; what is None or absent stays as built in."""

    detection: DataFrame | None = None
    classes: dict[str, tuple] = field(default_factory=dict)
    mappings: DataFrame | None = None
    years: DataFrame | None = None
    profile: Profile = Profile()
    impacts: DataFrame | None = None
    weights: tuple[float, ...] = R.WEIGHTS
    steps: tuple = R.STEPS


def load_rule_tables(spark: SparkSession, **paths: str) -> RuleTables:
    """Rule files by what they hold: detection, classification, sensitivity, criticality, mappings, years, profile, impacts, weights, steps."""
    passes = ("classification", "sensitivity", "criticality")
    loaders = {"detection": load_detection_rules, "mappings": load_mappings, "years": load_years, "profile": load_profile, "impacts": load_impacts, "weights": load_weights, "steps": load_steps}
    if unknown := set(paths) - {*passes, *loaders}:
        raise ValueError(f"unknown rule tables: {sorted(unknown)}")
    return RuleTables(classes={k: load_classification(spark, p) for k, p in paths.items() if k in passes}, **{k: loaders[k](spark, p) for k, p in paths.items() if k in loaders})

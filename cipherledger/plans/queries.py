"""Queries by survey row over the fixture views, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import extract as X
from ..operators import inventory as I
from ..operators import reach as G
from ..operators import reads as M
from ..operators import risk as K
from . import rules as R
from .fixtures import ctes, load

AS_OF = "2024-02-01 00:00:00"
SCANNED = ("source_code", "binary", "container", "certificate")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Oracle CTEs: rule tables as VALUES, then the stages in plain SQL.


def _s(v: object) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def _case(table: tuple, fallback: str, what: int = 5) -> str:
    whens = []
    for surfaces, purposes, prefixes, paths, classified, *_ in table:
        parts = []
        if surfaces:
            parts.append(f"source_surface IN ({', '.join(map(_s, surfaces))})")
        if purposes:
            parts.append(f"purpose IN ({', '.join(map(_s, purposes))})")
        if prefixes:
            parts.append("(" + " OR ".join(f"starts_with(upper(algorithm), {_s(p)})" for p in prefixes) + ")")
        if paths:
            parts.append("(" + " OR ".join(f"contains(lower(file_path), {_s(p)})" for p in paths) + ")")
        if classified:
            parts.append(f"classification = {_s(classified)}")
        whens.append(" AND ".join(parts))
    return "CASE " + " ".join(f"WHEN {w} THEN {_s(r[what])}" for w, r in zip(whens, table, strict=True)) + f" ELSE {_s(fallback)} END"


_KEY = "PARTITION BY upper(algorithm), purpose, file_path, line_number"
_FAM = "CASE " + " ".join(f"WHEN upper(algorithm) = '{f}' OR starts_with(upper(algorithm), '{f}-') THEN '{f}'" for f in R.FAMILIES) + " ELSE algorithm END"
_DEDUP = f"dd AS (SELECT * FROM (SELECT *, row_number() OVER ({_KEY} ORDER BY confidence DESC, seq) AS rn, count(*) OVER ({_KEY}) AS n_observed, min(seq) OVER ({_KEY}) AS first_seq FROM findings) WHERE rn = 1)"
_MAPS = "maps(ord, pattern, mp, vulnerable, broken, weakened, replacement, status, path_type, path, alternative, n_protocols) AS (VALUES " + ", ".join("(" + ", ".join(_s(v) for v in (i, *m[:10], len(m[10] or ()))) + ")" for i, m in enumerate(R.MAPPINGS)) + ")"
_YEARS = "years(o, pattern, mp, y) AS (VALUES " + ", ".join(f"({i}, {_s(p)}, {_s(q)}, {y})" for i, (p, q, y) in enumerate(R.MIGRATION_YEARS)) + ")"
_IMPACTS = "impacts(o, prefix, ip, total, scores) AS (VALUES " + ", ".join(f"({i}, {_s(p)}, {_s(q)}, {round(sum(a * w for a, w in zip(s, R.WEIGHTS, strict=True)), 10)}, {_s(','.join(f'{x:.1f}' for x in s))})" for i, (p, q, s) in enumerate(R.IMPACTS)) + ")"
_X = "CASE " + " ".join(f"WHEN classification = '{c}' AND sensitivity = '{s}' THEN {x}" for c, s, x in R.SHELF_LIFE) + " WHEN classification = 'infrastructure' THEN 10 WHEN classification = 'application' THEN 20 ELSE 10 END"
_CLASSED = [
    _DEDUP,
    f"c1 AS (SELECT *, {_case(R.CLASSIFICATION, 'application')} AS classification, {_case(R.CLASSIFICATION, 'fallback', 6)} AS classification_rule FROM dd)",
    f"c2 AS (SELECT *, {_case(R.SENSITIVITY, 'internal')} AS sensitivity, {_case(R.SENSITIVITY, 'fallback', 6)} AS sensitivity_rule FROM c1)",
    f"cl AS (SELECT *, {_case(R.CRITICALITY, 'low')} AS criticality, {_case(R.CRITICALITY, 'fallback', 6)} AS criticality_rule FROM c2)",
]
_PAIRS = [
    "ap AS (SELECT DISTINCT algorithm, purpose FROM cl)",
    "bm AS (SELECT algorithm, purpose, ord FROM (SELECT a.algorithm, a.purpose, ord, row_number() OVER (PARTITION BY a.algorithm, a.purpose ORDER BY length(pattern) DESC, ord) AS r FROM ap a JOIN maps m ON m.mp = a.purpose AND starts_with(upper(a.algorithm), m.pattern)) WHERE r = 1)",
    "yy AS (SELECT algorithm, purpose, y FROM (SELECT a.algorithm, a.purpose, y, row_number() OVER (PARTITION BY a.algorithm, a.purpose ORDER BY length(pattern) DESC, o) AS r FROM ap a JOIN years t ON t.mp = a.purpose AND starts_with(upper(a.algorithm), t.pattern)) WHERE r = 1)",
]


def _scored(z: str = "10", src: str = "cl", name: str = "rk") -> list[str]:
    p = "CASE WHEN broken THEN 'P1' WHEN NOT vulnerable AND NOT weakened THEN 'P4' WHEN NOT vulnerable THEN 'P3' WHEN urgency_flag AND hndl_flag THEN 'P1' WHEN urgency_flag OR hndl_flag THEN 'P2' ELSE 'P3' END"
    return [
        f"{name}0 AS (SELECT s.*, m.ord AS mapping_ord, coalesce(m.vulnerable, true) AS vulnerable, coalesce(m.broken, false) AS broken, coalesce(m.weakened, false) AS weakened, m.replacement, m.status, m.path_type, m.path, m.alternative, m.n_protocols, {_X} AS x_years, coalesce(y.y, 2) AS y_years, {z} AS z_years FROM {src} s LEFT JOIN bm b ON b.algorithm = s.algorithm AND b.purpose = s.purpose LEFT JOIN maps m ON m.ord = b.ord LEFT JOIN yy y ON y.algorithm = s.algorithm AND y.purpose = s.purpose)",
        f"{name}1 AS (SELECT *, x_years + y_years > z_years AS urgency_flag, CASE WHEN purpose IN ('hashing', 'mac', 'random_generation', 'key_derivation') OR NOT vulnerable THEN false WHEN purpose IN ('key_establishment', 'encryption') THEN x_years >= 3 WHEN purpose = 'digital_signature' THEN x_years >= 5 ELSE false END AS hndl_flag FROM {name}0)",
        f"{name} AS (SELECT *, {p} AS priority FROM {name}1)",
    ]


_REC = "rc AS (SELECT *, CASE WHEN mapping_ord IS NULL THEN 'unknown' WHEN NOT vulnerable AND NOT weakened THEN 'no_action' WHEN status = 'under_standardization' THEN 'unknown' ELSE 'migrate' END AS rec_kind FROM rk)"
_REC2 = "re AS (SELECT *, CASE rec_kind WHEN 'unknown' THEN 'UNKNOWN — see the replacement mappings' ELSE replacement END AS rec_replacement, CASE rec_kind WHEN 'unknown' THEN 'manual review required' ELSE path END AS rec_path, CASE rec_kind WHEN 'unknown' THEN 'hybrid' WHEN 'no_action' THEN 'no_action' ELSE path_type END AS rec_path_type, CASE rec_kind WHEN 'unknown' THEN 'classical' ELSE status END AS rec_status, CASE rec_kind WHEN 'migrate' THEN alternative END AS rec_alternative FROM rc)"
_MIG = [
    _IMPACTS,
    "im AS (SELECT algorithm, purpose, total, scores FROM (SELECT a.algorithm, a.purpose, total, scores, row_number() OVER (PARTITION BY a.algorithm, a.purpose ORDER BY length(prefix) + CASE WHEN ip IS NULL THEN 0 ELSE 100 END DESC, o) AS r FROM ap a JOIN impacts i ON starts_with(upper(a.algorithm), prefix) AND (ip IS NULL OR ip = a.purpose)) WHERE r = 1)",
    "mg AS (SELECT r.*, scores, round(least(1.0, total), 4) AS composite FROM re r JOIN im ON im.algorithm = r.algorithm AND im.purpose = r.purpose)",
]
_BASE = [*ctes("findings")]
_RISK = [*_BASE, *_CLASSED, _MAPS, _YEARS, *_PAIRS, *_scored()]
_RECS = [*_RISK, _REC, _REC2]


def _with(parts: list[str], tail: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + tail


def findings(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "findings")


def assets(spark: SparkSession, d: str) -> DataFrame:
    return C.classify(I.deduplicate(findings(spark, d)))


def scored(spark: SparkSession, d: str) -> DataFrame:
    return K.score(assets(spark, d))


def recommended(spark: SparkSession, d: str) -> DataFrame:
    return K.recommend(scored(spark, d))


def _n(*keys: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.groupBy(*keys).agg(F.count("*").alias("n"))


# Inventory


@query(_with([*_BASE, _DEDUP], "SELECT seq, algorithm, purpose, file_path, line_number, confidence, n_observed, first_seq FROM dd"))
def d02_dedup(spark: SparkSession, d: str) -> DataFrame:
    return I.deduplicate(findings(spark, d)).select("seq", "algorithm", "purpose", "file_path", "line_number", "confidence", "n_observed", "first_seq")


@query(_with(_BASE, "SELECT seq, substr(sha256(concat_ws('|', upper(algorithm), purpose, file_path, coalesce(CAST(line_number AS VARCHAR), ''))), 1, 16) AS dedup_key FROM findings"))
def d01_dedup_key(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select("seq", I.dedup_key().alias("dedup_key"))


@query(_with([*_BASE, "o AS (SELECT *, CASE WHEN seq % 3 = 0 THEN concat('o', CAST(seq % 7 AS VARCHAR)) END AS owner FROM findings)", f"b AS (SELECT *, max(confidence) OVER ({_KEY} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM o)"], "SELECT max(seq) AS seq, arg_max(owner, seq) FILTER (owner IS NOT NULL) AS owner FROM b WHERE m IS NULL OR confidence > m GROUP BY upper(algorithm), purpose, file_path, line_number"))
def d03_merge_blanks(spark: SparkSession, d: str) -> DataFrame:
    x = findings(spark, d).withColumn("owner", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("o"), (F.col("seq") % 7).cast("string"))))
    return I.merge_blanks(x, ["owner"]).select("seq", "owner")


@query(_with(_BASE, "SELECT seq, algorithm, purpose, file_path, line_number, rule_id, confidence FROM findings"))
def d04_observations(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select("seq", "algorithm", "purpose", "file_path", "line_number", "rule_id", "confidence")


@query(_with(_BASE, f"SELECT {_FAM} AS family, count(*) AS n FROM findings GROUP BY 1"))
def d05_families(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).groupBy(I.family_of(F.col("algorithm")).alias("family")).agg(F.count("*").alias("n"))


_GROUP = f"g AS (SELECT {_FAM} AS family, * FROM findings)"


@query(_with([*_BASE, _GROUP], "SELECT family, purpose, source_surface, count(*) AS observation_count, count(DISTINCT algorithm) AS n_variants, count(DISTINCT (file_path, line_number)) AS location_count FROM g GROUP BY ALL"))
def d06_groups(spark: SparkSession, d: str) -> DataFrame:
    g = I.family_groups(findings(spark, d))
    return g.select("family", "purpose", "source_surface", "observation_count", F.size("variants").cast("long").alias("n_variants"), "location_count")


@query(_with([*_BASE, _GROUP, "p AS (SELECT DISTINCT family, purpose, source_surface, file_path, line_number FROM g)", "r AS (SELECT *, row_number() OVER (PARTITION BY family, purpose, source_surface ORDER BY file_path, line_number) AS k FROM p)"], "SELECT family, purpose, source_surface, string_agg(concat(file_path, ':', line_number), ';' ORDER BY k) AS locations FROM r WHERE k <= 50 GROUP BY ALL"))
def d07_group_locations(spark: SparkSession, d: str) -> DataFrame:
    return I.family_groups(findings(spark, d)).select("family", "purpose", "source_surface", F.array_join("locations", ";").alias("locations"))


@query(_with([*_BASE, _DEDUP], "SELECT count(*) AS unique_assets, (SELECT count(*) FROM findings) AS total, (SELECT count(*) FROM findings) - count(*) AS duplicates, round(1.0 - count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM findings), 4) AS duplicate_rate FROM dd"))
def d08_stats(spark: SparkSession, d: str) -> DataFrame:
    return I.stats(findings(spark, d))


@query(_with([*_BASE, f"f AS (SELECT algorithm, purpose, row_number() OVER ({_KEY} ORDER BY seq) AS r FROM findings)"], "SELECT algorithm, purpose, count(*) AS n FROM f WHERE r = 1 GROUP BY ALL"))
def d08_first_spelling(spark: SparkSession, d: str) -> DataFrame:
    return I.counts_by_first_spelling(findings(spark, d))


@query(_with([*_BASE, _DEDUP], "SELECT seq, file_path, line_number FROM dd ORDER BY file_path, coalesce(line_number, 0), first_seq"))
def d09_ordered(spark: SparkSession, d: str) -> DataFrame:
    return I.in_order(I.deduplicate(findings(spark, d))).select("seq", "file_path", "line_number")


@query(_with([*_BASE, _DEDUP], "SELECT seq, algorithm FROM dd WHERE starts_with(upper(algorithm), 'RSA')"))
def d10_by_algorithm(spark: SparkSession, d: str) -> DataFrame:
    return I.by_algorithm(I.deduplicate(findings(spark, d)), "rsa").select("seq", "algorithm")


@query(_with([*_BASE, _DEDUP], "SELECT seq, purpose FROM dd WHERE purpose = 'hashing'"))
def d11_by_purpose(spark: SparkSession, d: str) -> DataFrame:
    return I.by_purpose(I.deduplicate(findings(spark, d)), "hashing").select("seq", "purpose")


@query(_with([*_BASE, _DEDUP], "SELECT seq, file_path FROM dd WHERE file_path = 'auth/mod4.py'"))
def d12_by_file(spark: SparkSession, d: str) -> DataFrame:
    return I.by_file(I.deduplicate(findings(spark, d)), "auth\\mod4.py").select("seq", "file_path")


@query(_with(_BASE, "SELECT seq, source_surface, CAST(CASE source_surface WHEN 'source_code' THEN 0 WHEN 'certificate' THEN 1 WHEN 'binary' THEN 2 ELSE 3 END AS INT) AS surface_ord FROM findings"))
def d13_union(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    return I.union_surfaces({s: f.filter(F.col("source_surface") == s) for s in SCANNED}).select("seq", "source_surface", "surface_ord")


@query(_with(_BASE, "SELECT string_agg(s, ',' ORDER BY s) AS surfaces FROM (SELECT source_surface AS s FROM findings UNION SELECT 'source_code')"))
def d14_surfaces(spark: SparkSession, d: str) -> DataFrame:
    return I.scanned_surfaces(findings(spark, d)).select(F.array_join("surfaces", ",").alias("surfaces"))


# Classification, lifecycle, ownership


@query(_with([*_BASE, *_CLASSED], "SELECT seq, classification, classification_rule, sensitivity, sensitivity_rule, criticality, criticality_rule FROM cl"))
def f03_classify(spark: SparkSession, d: str) -> DataFrame:
    return assets(spark, d).select("seq", "classification", "classification_rule", "sensitivity", "sensitivity_rule", "criticality", "criticality_rule")


@query(_with([*_BASE, *_CLASSED], "SELECT classification, count(*) AS n FROM cl GROUP BY 1"))
def f08_class_totals(spark: SparkSession, d: str) -> DataFrame:
    return _n("classification")(assets(spark, d))


@query(_with(ctes("certs"), "SELECT cert_id, CASE WHEN days_to_expiry < 0 THEN 'expired' WHEN days_to_expiry <= 90 THEN 'rotation_pending' ELSE 'active' END AS lifecycle FROM certs"))
def f07_certificate_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "certs").withColumn("expiry", F.to_timestamp(F.lit(AS_OF)) + F.make_interval(days="days_to_expiry"))
    return c.select("cert_id", C.certificate_stage(C.days_to(F.col("expiry"), F.to_timestamp(F.lit(AS_OF)))).alias("lifecycle"))


@query(_with(_BASE, "SELECT seq, CASE WHEN " + " OR ".join(f"starts_with(upper(algorithm), '{p}')" for p in R.LEGACY) + " THEN 'legacy' ELSE 'active' END AS lifecycle FROM findings"))
def f07_algorithm_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select("seq", C.algorithm_stage().alias("lifecycle"))


@query(_with([*ctes("findings", "owner_rules"), "o AS (SELECT f.seq, r.owner, row_number() OVER (PARTITION BY f.seq ORDER BY r.priority DESC, r.id) AS k FROM findings f LEFT JOIN owner_rules r ON (r.surface IS NULL OR r.surface = f.source_surface) AND (r.purpose IS NULL OR r.purpose = f.purpose) AND (r.algorithm_prefix IS NULL OR starts_with(upper(f.algorithm), upper(r.algorithm_prefix))) AND (r.path_contains IS NULL OR contains(lower(f.file_path), lower(r.path_contains))))"], "SELECT seq, owner FROM o WHERE k = 1"))
def f09_owners(spark: SparkSession, d: str) -> DataFrame:
    return C.assign_owners(findings(spark, d), load(spark, d, "owner_rules")).select("seq", "owner")


# Completeness

_COVER = "cat(c) AS (VALUES " + ", ".join(f"('{c}')" for c in R.CATEGORIES) + ")"


@query(_with([*_BASE, _DEDUP], "SELECT s AS surface, CASE WHEN s = 'infrastructure' THEN 'skipped' ELSE 'scanned' END AS state, s <> 'infrastructure' AS scanned, count(seq) AS assets_found FROM (VALUES " + ", ".join(f"('{s}')" for s in R.SURFACES) + ") v(s) LEFT JOIN dd ON source_surface = s GROUP BY ALL"))
def h01_surfaces(spark: SparkSession, d: str) -> DataFrame:
    return M.surface_coverage(I.deduplicate(findings(spark, d)), SCANNED)


@query(_with([*_BASE, _DEDUP, _COVER, "n AS (SELECT purpose, count(*) AS n, string_agg(DISTINCT algorithm, ',' ORDER BY algorithm) AS a FROM dd GROUP BY 1)"], "SELECT coalesce(c, purpose) AS category, c IS NOT NULL AS expected, n IS NOT NULL AS found, coalesce(n, 0) AS asset_count, coalesce(a, '') AS algorithms FROM cat FULL JOIN n ON c = purpose"))
def h02_categories(spark: SparkSession, d: str) -> DataFrame:
    return M.category_coverage(I.deduplicate(findings(spark, d))).withColumn("algorithms", F.array_join("algorithms", ","))


@query(_with([*_BASE, _COVER, "h AS (SELECT c, c IN (SELECT purpose FROM findings) AS f FROM cat)"], "SELECT round(80.0, 1) AS surface_pct, round(100.0 * count(*) FILTER (f) / 7.0, 1) AS category_pct, round(0.3 * 80.0 + 0.7 * (100.0 * count(*) FILTER (f) / 7.0), 1) AS overall_pct, coalesce(string_agg(c, ',' ORDER BY c) FILTER (NOT f), '') AS missing_categories, 'infrastructure' AS unscanned_surfaces FROM h"))
def h03_completeness(spark: SparkSession, d: str) -> DataFrame:
    return M.completeness(findings(spark, d), SCANNED)


# Risk, recommendation, migration


@query(_with(_RISK, "SELECT seq, CAST(mapping_ord AS INT) AS mapping_ord, CAST(x_years AS INT) AS x_years, CAST(y_years AS INT) AS y_years, urgency_flag, hndl_flag, priority FROM rk"))
def i04_risk(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("seq", "mapping_ord", "x_years", "y_years", "urgency_flag", "hndl_flag", "priority")


@query(_with(_RISK, "SELECT classification, priority, count(*) AS n FROM rk GROUP BY ALL"))
def i06_priorities(spark: SparkSession, d: str) -> DataFrame:
    return _n("classification", "priority")(scored(spark, d))


@query(_with(_RISK, "SELECT seq, CAST(CASE WHEN classification = 'infrastructure' THEN CASE WHEN criticality IN ('critical', 'high') THEN 1.0 ELSE 0.9 END WHEN criticality = 'critical' THEN 1.0 WHEN criticality = 'high' THEN 0.9 WHEN criticality = 'medium' THEN 0.7 ELSE 0.5 END AS DOUBLE) AS classification_weight, CAST(CASE seq % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.8 END AS DOUBLE) AS reachability_weight FROM rk"))
def i08_weights(spark: SparkSession, d: str) -> DataFrame:
    a = assets(spark, d).withColumn("reachable", F.when(F.col("seq") % 3 == 0, True).when(F.col("seq") % 3 == 1, False))
    return K.score(a).select("seq", "classification_weight", "reachability_weight")


_SC = [*_BASE, *_CLASSED, _MAPS, _YEARS, *_PAIRS, "sz AS (SELECT cl.*, scenario, z FROM cl, (VALUES ('conservative', 10), ('moderate', 15), ('optimistic', 20)) v(scenario, z))", *_scored("z", "sz")]


@query(_with(_SC, "SELECT scenario, priority, count(*) AS n, count(*) FILTER (urgency_flag) AS urgent FROM rk GROUP BY ALL"))
def i10_scenarios(spark: SparkSession, d: str) -> DataFrame:
    return K.scenarios(assets(spark, d)).groupBy("scenario", "priority").agg(F.count("*").alias("n"), F.count_if("urgency_flag").alias("urgent"))


@query(_with(_RECS, "SELECT seq, rec_kind, rec_replacement, rec_path, rec_path_type, rec_status, rec_alternative FROM re"))
def j03_recommend(spark: SparkSession, d: str) -> DataFrame:
    return recommended(spark, d).select("seq", "rec_kind", "rec_replacement", "rec_path", "rec_path_type", "rec_status", "rec_alternative")


@query(_with(_RECS, "SELECT seq, CASE WHEN rec_kind = 'migrate' AND path_type = 'hybrid' THEN replace(rec_path, 'hybrid:', 'pure-pqc:') ELSE rec_path END AS rec_path, CASE WHEN rec_kind = 'migrate' AND path_type = 'hybrid' THEN 'pure_pqc' ELSE rec_path_type END AS rec_path_type FROM re"))
def j04_greenfield(spark: SparkSession, d: str) -> DataFrame:
    return K.recommend(scored(spark, d), greenfield=True).select("seq", "rec_path", "rec_path_type")


@query(_with(_RECS, "SELECT rec_kind, count(*) AS n FROM rc GROUP BY 1"))
def j06_totals(spark: SparkSession, d: str) -> DataFrame:
    return _n("rec_kind")(recommended(spark, d))


@query(_with(_RISK, "SELECT seq FROM rk0 JOIN maps m ON m.ord = mapping_ord WHERE m.mp <> purpose"))
def j08_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return K.purpose_mismatches(scored(spark, d)).select("seq")


_STEPS = "CASE rec_path_type " + " ".join(f"WHEN '{k}' THEN {_s('|'.join(v))}" for k, v in R.STEPS) + f" ELSE {_s('|'.join(R.STEPS[0][1]))} END"
_LEVEL = "CASE WHEN composite < 0.25 THEN 'low' WHEN composite < 0.5 THEN 'moderate' WHEN composite < 0.75 THEN 'high' ELSE 'critical' END"
_WHEN = "CASE priority WHEN 'P1' THEN 'immediate' WHEN 'P2' THEN 'near-term' WHEN 'P4' THEN 'monitor' ELSE 'planned' END"


@query(_with([*_RECS, *_MIG], f"SELECT seq, CAST(composite AS DOUBLE) AS composite, {_LEVEL} AS impact_level, {_WHEN} AS migration_priority, {_STEPS} AS steps, scores FROM mg"))
def k02_migration(spark: SparkSession, d: str) -> DataFrame:
    return K.migration(recommended(spark, d)).select("seq", "composite", "impact_level", "migration_priority", F.array_join("steps", "|").alias("steps"), F.array_join(F.transform("factor_scores", lambda x: F.format_string("%.1f", x)), ",").alias("scores"))


@query(_with([*_RECS, *_MIG], "SELECT seq, concat(algorithm, ' used for ', replace(purpose, '_', ' '), ' at ', file_path, ':', line_number) AS current_state, CASE WHEN NOT urgency_flag AND NOT hndl_flag THEN concat('priority ', priority, ' — migration recommended') ELSE concat_ws('; ', CASE WHEN urgency_flag THEN concat('quantum-urgent (X=', x_years, 'yr + Y=', y_years, 'yr > Z=', z_years, 'yr threat timeline)') END, CASE WHEN hndl_flag THEN 'HNDL exposure: adversaries may already be harvesting ciphertext' END) END AS risk_context, concat('Migrate to ', rec_replacement, ' [', rec_status, '] via ', rec_path, ' strategy') AS action, CAST(greatest(1, CASE rec_kind WHEN 'migrate' THEN n_protocols ELSE 0 END + CASE classification WHEN 'infrastructure' THEN 2 ELSE 0 END) AS INT) AS n_components FROM mg"))
def k05_texts(spark: SparkSession, d: str) -> DataFrame:
    return K.migration(recommended(spark, d)).select("seq", "current_state", "risk_context", "action", F.size("components").alias("n_components"))


@query(_with([*_RECS, *_MIG], f"SELECT {_WHEN} AS migration_priority, count(*) AS n, round(avg(composite), 4) AS mean_composite FROM mg GROUP BY 1"))
def k09_stats(spark: SparkSession, d: str) -> DataFrame:
    return K.migration_stats(K.migration(recommended(spark, d)))


# Extraction


@query(_with(ctes("code_lines"), "SELECT file_path, count(*) AS n FROM code_lines GROUP BY 1"))
def b03_line_counts(spark: SparkSession, d: str) -> DataFrame:
    return _n("file_path")(load(spark, d, "code_lines"))


_FP = "fp(rule_id, pattern, algorithm) AS (VALUES " + ", ".join(f"({_s(r)}, {_s(p)}, {_s(a)})" for r, p, a, _, _ in R.FINGERPRINTS) + ")"


@query(_with([*ctes("blobs"), _FP], "SELECT file_path, rule_id, arg_min(s, pos) AS observed, any_value(algorithm) AS algorithm FROM blobs JOIN fp ON regexp_matches(s, pattern, 'i') GROUP BY ALL"))
def b14_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return X.match_strings(load(spark, d, "blobs")).select("file_path", "rule_id", "observed", "algorithm")


_CT = "ct(rule_id, pattern, algorithm) AS (VALUES " + ", ".join(f"({_s(r)}, {_s(p)}, {_s(a)})" for r, p, a, _, _ in R.CONTAINER) + ")"


@query(_with([*ctes("manifest_lines"), _CT], "SELECT concat(image_ref, ' :: ', manifest) AS location, rule_id, min(line_no) AS line_no, any_value(algorithm) AS algorithm FROM manifest_lines JOIN ct ON regexp_matches(line, pattern, 'i') WHERE lower(manifest) IN ('requirements.txt', 'dockerfile') GROUP BY ALL"))
def b15_manifests(spark: SparkSession, d: str) -> DataFrame:
    return X.match_manifests(load(spark, d, "manifest_lines"))


_CIPHER = "CASE WHEN contains(u, 'TLS_AES_') OR contains(u, 'TLS_CHACHA20') THEN 'I-001' WHEN contains(u, 'ECDH') THEN 'I-002' WHEN contains(u, 'DHE') OR contains(u, 'DH_ANON') OR contains(u, 'DH-DSS') THEN 'I-003' WHEN regexp_matches(u, '\\bRSA\\b|AES.*SHA|CAMELLIA|SEED') THEN 'I-004' WHEN regexp_matches(u, 'RC4|DES|MD5|EXPORT|NULL|ANON') THEN 'I-005' END"


@query(_with([*ctes("handshakes"), "h AS (SELECT event_id, upper(cipher_suite) AS u FROM handshakes)", f"r AS (SELECT event_id, {_CIPHER} AS rule_id FROM h)"], "SELECT event_id, rule_id FROM r WHERE rule_id IS NOT NULL"))
def b16_ciphers(spark: SparkSession, d: str) -> DataFrame:
    return X.match_ciphers(load(spark, d, "handshakes")).select("event_id", "rule_id")


@query(_with(ctes("handshakes"), "SELECT event_id, split_part(endpoint, ':', 1) AS host, CASE WHEN contains(endpoint, ':') THEN CAST(split_part(endpoint, ':', 2) AS INT) ELSE 443 END AS port FROM handshakes"))
def a15_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "handshakes").select("event_id", X.parse_endpoint(F.col("endpoint")).alias("e")).select("event_id", "e.host", "e.port")


@query(_with(ctes("manifest_lines"), "SELECT DISTINCT image_ref, CAST(NULL AS VARCHAR) AS registry, split_part(image_ref, ':', 1) AS name, split_part(image_ref, ':', 2) AS tag, CAST(NULL AS VARCHAR) AS digest, 'recorded' AS status FROM manifest_lines"))
def a14_images(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "manifest_lines").select("image_ref").distinct().transform(X.image_refs)


_CERTS = "ca AS (SELECT cert_id, serial, 'C-001' AS rule_id, CASE pk_type WHEN 'RSA' THEN 'RSA-2048' WHEN 'EC' THEN 'ECDSA-P256' WHEN 'DSA' THEN 'DSA-1024' ELSE 'Ed25519' END AS algorithm, CASE pk_type WHEN 'RSA' THEN 'key_establishment' ELSE 'digital_signature' END AS purpose FROM certs WHERE pk_type <> 'GOST' UNION ALL SELECT cert_id, serial, 'C-002', CASE sig_hash WHEN 'sha256' THEN 'SHA-256' WHEN 'sha1' THEN 'SHA-1' ELSE 'MD5' END, 'hashing' FROM certs WHERE sig_hash IS NOT NULL)"


@query(_with([*ctes("certs"), _CERTS], "SELECT cert_id, rule_id, algorithm, purpose FROM ca"))
def b19_certificates(spark: SparkSession, d: str) -> DataFrame:
    return X.certificate_assets(load(spark, d, "certs")).select("cert_id", "rule_id", "algorithm", "purpose")


@query(_with(ctes("certs"), "SELECT cert_id, CASE WHEN cert_id % 7 = 0 THEN 'O=none' WHEN cert_id % 11 > 0 THEN regexp_extract(subject, 'CN=([^,]*)', 1) ELSE pk_type END AS common_name FROM certs"))
def b21_common_names(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "certs").select("cert_id", X.display_name(F.when(F.col("cert_id") % 7 == 0, "O=none").when(F.col("cert_id") % 11 > 0, F.col("subject")), F.col("pk_type")).alias("common_name"))


@query(_with(_BASE, "SELECT seq, round(least(1.0, confidence + CASE WHEN seq % 2 = 0 THEN 0.01 ELSE 0 END) - CASE WHEN seq % 5 = 0 THEN 0.05 ELSE 0 END, 4) AS confidence FROM findings"))
def c03_confidence(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select("seq", X.confidence(F.col("confidence"), F.col("seq") % 2 == 0, F.col("seq") % 5 == 0).alias("confidence"))


@query(_with(_BASE, "SELECT seq, 'line below 1' AS problem FROM findings WHERE line_number - 3 < 1"))
def c07_violations(spark: SparkSession, d: str) -> DataFrame:
    return X.violations(findings(spark, d).withColumn("line_number", F.col("line_number") - 3))


# Enrichment


def _chain(source: str, patterns: list[tuple[str, str]], mark: str) -> list[str]:
    """CTEs k_0 to k_n: patterns are replaced in s in order, and f lists the names of those found."""
    out = [f"k_0 AS (SELECT doc_id, {source} AS s, CAST([] AS VARCHAR[]) AS f FROM snippets)"]
    for k, (name, p) in enumerate(patterns):
        out.append(f"k_{k + 1} AS (SELECT doc_id, regexp_replace(s, {_s(p)}, {_s(mark)}, 'g') AS s, CASE WHEN regexp_matches(s, {_s(p)}) THEN list_append(f, {_s(name)}) ELSE f END AS f FROM k_{k})")
    return [*ctes("snippets"), *out]


_SECRETS = [("aws_key", "AKIA[0-9A-Z]{16}"), ("jwt", r"eyJ[\w-]+\.[\w-]+\.[\w-]+"), ("private_key", "(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"), ("hex_secret", r"\b[0-9a-fA-F]{64}\b")]
_PHRASES = [(n, p.replace("(?m)", "(?im)") if p.startswith("(?m)") else f"(?i){p}") for n, p in R.INJECTIONS]


@query(_with(_chain("snippet", _SECRETS, "[REDACTED]"), f"SELECT doc_id, sha256(s) AS scrubbed, array_to_string(f, ',') AS found FROM k_{len(_SECRETS)}"))
def e02_scrub(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "snippets").select("doc_id", X.scrubbed(F.col("snippet")).alias("x"))
    return x.select("doc_id", F.sha2("x.t", 256).alias("scrubbed"), F.array_join("x.n", ",").alias("found"))


@query(_with([*ctes("snippets"), "c AS (SELECT doc_id, unnest(string_split(snippet, '')) AS ch, length(snippet) AS n FROM snippets)", "p AS (SELECT doc_id, count(*) / CAST(any_value(n) AS DOUBLE) AS p FROM c GROUP BY doc_id, ch)"], "SELECT s.doc_id, round(coalesce(e, 0), 4) AS entropy FROM snippets s LEFT JOIN (SELECT doc_id, -sum(p * log2(p)) AS e FROM p GROUP BY 1) x ON x.doc_id = s.doc_id"))
def e03_entropy(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "snippets").select("doc_id", X.entropy(F.col("snippet")).alias("entropy"))


@query(_with(_chain("regexp_replace(snippet, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}\\p{Cf}]', '', 'g')", _PHRASES, "[STRIPPED]"), f"SELECT doc_id, array_to_string(f, ',') AS fired, sha256(s) AS stripped FROM k_{len(_PHRASES)}"))
def e05_injections(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "snippets").select("doc_id", X.stripped(F.col("snippet")).alias("x"))
    return x.select("doc_id", F.array_join("x.n", ",").alias("fired"), F.sha2("x.t", 256).alias("stripped"))


@query(_with(ctes("snippets"), "SELECT doc_id, CAST(CASE WHEN length(snippet) > 2048 THEN 2048 + 12 ELSE length(snippet) END AS INT) AS n, length(snippet) > 2048 AS truncated, concat('llm:', sha256(concat(snippet, '|v1'))) AS cache_key FROM snippets"))
def e06_truncate_key(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "snippets").select("doc_id", F.length(X.truncate(F.col("snippet"))[0]).alias("n"), X.truncate(F.col("snippet"))[1].alias("truncated"), X.cache_key(F.col("snippet")).alias("cache_key"))


# Reachability

_ENDS = "reach(node) AS (SELECT qualified_name FROM functions WHERE is_entry_point UNION SELECT c.callee FROM reach r JOIN calls c ON c.caller = r.node)"


_DEPTHS = "dp(node, depth) AS (SELECT qualified_name, 0 FROM functions WHERE is_entry_point UNION SELECT c.callee, depth + 1 FROM dp r JOIN calls c ON c.caller = r.node WHERE depth < 40)"


@query(_with([*ctes("functions", "calls"), _DEPTHS], "SELECT node, min(depth) AS depth FROM dp GROUP BY 1"))
def g08_reachable(spark: SparkSession, d: str) -> DataFrame:
    return G.search(load(spark, d, "functions"), load(spark, d, "calls")).select("node", "depth")


@query(_with([*ctes("functions", "calls"), "k AS (SELECT DISTINCT qualified_name FROM functions)"], "SELECT caller, callee, qualified_name IS NULL AS external FROM calls LEFT JOIN k ON callee = qualified_name"))
def g05_callees(spark: SparkSession, d: str) -> DataFrame:
    return G.resolve_callees(load(spark, d, "calls"), load(spark, d, "functions"))


@query(_with([*ctes("findings", "functions"), "fn AS (SELECT file_path, CAST(start_line AS INT) AS start_line, max(qualified_name) AS q FROM functions GROUP BY ALL)"], "SELECT f.seq, f.file_path, f.line_number, q AS function FROM findings f ASOF LEFT JOIN fn ON f.file_path = fn.file_path AND f.line_number >= fn.start_line WHERE source_surface = 'source_code'"))
def g09_containing(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).filter("source_surface = 'source_code'")
    return G.containing_function(f, load(spark, d, "functions"))


_JUDGED = [*ctes("findings", "functions", "calls"), _ENDS, "fn AS (SELECT file_path, CAST(start_line AS INT) AS start_line, max(qualified_name) AS q FROM functions GROUP BY ALL)", "ju AS (SELECT f.seq, CASE WHEN q IS NULL THEN NULL ELSE q IN (SELECT node FROM reach) END AS reachable FROM (SELECT * FROM findings WHERE source_surface = 'source_code') f ASOF LEFT JOIN fn ON f.file_path = fn.file_path AND f.line_number >= fn.start_line)", "jj AS (SELECT f.seq, reachable FROM findings f LEFT JOIN ju ON ju.seq = f.seq)"]


@query(_with(_JUDGED, "SELECT seq, reachable FROM jj"))
def g10_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return G.verdicts(findings(spark, d), load(spark, d, "functions"), load(spark, d, "calls")).select("seq", "reachable")


@query(_with(_JUDGED, "SELECT count(*) AS total, count(*) FILTER (reachable) AS reachable, count(*) FILTER (NOT reachable) AS unreachable, count(*) FILTER (reachable IS NULL) AS unknown, round(count(*) FILTER (reachable) / nullif(CAST(count(reachable) AS DOUBLE), 0), 4) AS rate FROM jj"))
def g12_report(spark: SparkSession, d: str) -> DataFrame:
    return G.report(G.verdicts(findings(spark, d), load(spark, d, "functions"), load(spark, d, "calls")))


# Relationships, components, quality, diff


@query(_with([*ctes("certs"), _CERTS], "SELECT concat(a.cert_id, a.rule_id) AS from_id, concat(b.cert_id, b.rule_id) AS to_id, CASE WHEN a.purpose = 'hashing' THEN 'cert_uses_key' ELSE 'cert_signed_with' END AS kind FROM ca a JOIN ca b ON a.serial = b.serial AND (a.purpose = 'hashing') <> (b.purpose = 'hashing')"))
def l01_certificate_edges(spark: SparkSession, d: str) -> DataFrame:
    a = X.certificate_assets(load(spark, d, "certs")).withColumn("asset_id", F.concat(F.col("cert_id").cast("string"), F.col("rule_id")))
    return M.certificate_edges(a).select("from_id", "to_id", "kind")


_SYM = [*_BASE, _DEDUP, "sy AS (SELECT *, CASE WHEN seq % 4 = 0 THEN 'nothing' ELSE concat('call ', sib, '()') END AS snippet FROM (SELECT seq, source_surface, rule_id AS own, concat('R-', (CAST(substr(rule_id, 3) AS INT) + 1) % 19) AS sib, row_number() OVER (PARTITION BY rule_id ORDER BY file_path, coalesce(line_number, 0), first_seq) AS r FROM dd))"]


@query(_with(_SYM, "SELECT a.seq AS from_id, b.seq AS to_id, 'source_invokes' AS kind FROM sy a JOIN sy b ON b.own = a.sib AND a.own <> a.sib WHERE a.source_surface = 'source_code' AND contains(a.snippet, a.sib) AND b.r <= 8"))
def l02_invokes(spark: SparkSession, d: str) -> DataFrame:
    nxt = F.concat(F.lit("R-"), ((F.substring("rule_id", 3, 9).cast("int") + 1) % 19).cast("string"))
    a = I.deduplicate(findings(spark, d)).withColumns({"observed_symbol": F.col("rule_id"), "sibling_symbols": F.array(F.col("rule_id"), nxt), "snippet": F.when(F.col("seq") % 4 == 0, "nothing").otherwise(F.concat(F.lit("call "), nxt, F.lit("()")))})
    return M.invokes_edges(a).select("from_id", "to_id", "kind")


_REP = [*_BASE, _DEDUP, f"rp AS (SELECT * FROM (SELECT {_FAM} AS family, source_surface, seq, row_number() OVER (PARTITION BY {_FAM}, source_surface ORDER BY file_path, coalesce(line_number, 0), first_seq) AS k FROM dd) WHERE k = 1)"]


@query(_with(_REP, "SELECT a.seq AS from_id, b.seq AS to_id, a.family, 'cross_surface' AS kind FROM rp a JOIN rp b ON a.family = b.family AND a.source_surface < b.source_surface"))
def l03_cross_surface(spark: SparkSession, d: str) -> DataFrame:
    return M.cross_surface_edges(I.deduplicate(findings(spark, d))).select("from_id", "to_id", "family", "kind")


@query(_with(_REP, "SELECT a.seq AS from_id, string_agg(b.seq, ',' ORDER BY b.seq) AS depends_on FROM rp a JOIN rp b ON a.family = b.family AND a.source_surface < b.source_surface GROUP BY 1"))
def l05_dependencies(spark: SparkSession, d: str) -> DataFrame:
    a = I.deduplicate(findings(spark, d))
    return M.dependencies(M.cross_surface_edges(a), a).select("from_id", F.array_join("depends_on", ",").alias("depends_on"))


_RATES = "avg(CASE WHEN seq % 7 > 0 THEN 1.0 ELSE 0 END) AS e, avg(CASE WHEN purpose <> 'unknown' THEN 1.0 ELSE 0 END) AS c, avg(CASE WHEN seq % 5 > 0 THEN 1.0 ELSE 0 END) AS r, avg(CASE WHEN seq % 3 > 0 THEN 1.0 ELSE 0 END) AS m, 1 - count(*) / CAST(sum(n_observed) AS DOUBLE) AS d"


@query(_with([*_RECS, f"qu AS (SELECT {_RATES} FROM re)"], "SELECT round(e, 4) AS evidence, round(c, 4) AS completeness, round(r, 4) AS risk, round(m, 4) AS recommendation, round(d, 4) AS duplicate_rate, round(0.30 * e + 0.20 * c + 0.25 * r + 0.25 * m, 4) AS overall FROM qu"))
def l09_quality(spark: SparkSession, d: str) -> DataFrame:
    some = lambda c, k: F.when(F.col("seq") % k > 0, F.col(c))
    return M.quality(recommended(spark, d).withColumns({"rule_id": some("rule_id", 7), "priority": some("priority", 5), "rec_replacement": some("rec_replacement", 3)}))


# Reads


@query(_with(_RISK, "SELECT count(*) AS total, count(*) FILTER (priority <> 'P4') AS quantum_vulnerable, count(*) FILTER (priority = 'P1') AS p1, count(*) FILTER (hndl_flag) AS hndl, count(*) FILTER (priority = 'P2') AS n_p2, count(*) FILTER (priority = 'P3') AS n_p3, count(*) FILTER (priority = 'P4') AS n_p4, count(*) FILTER (classification = 'application') AS n_application, count(*) FILTER (classification = 'infrastructure') AS n_infrastructure FROM rk"))
def m03_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return M.dashboard(scored(spark, d))


@query(_with(_RISK, "SELECT seq, algorithm, priority FROM rk WHERE contains(lower(algorithm), 'rsa') AND source_surface = 'source_code' ORDER BY priority, seq LIMIT 50 OFFSET 100"))
def m02_page(spark: SparkSession, d: str) -> DataFrame:
    return M.page(scored(spark, d), algorithm="RSA", surface="source_code", sort="priority", limit=50, offset=100)[0].select("seq", "algorithm", "priority")


@query(_with(_RISK, "SELECT count(*) AS total FROM rk WHERE contains(lower(algorithm), 'rsa') AND source_surface = 'source_code'"))
def m02_total(spark: SparkSession, d: str) -> DataFrame:
    return M.page(scored(spark, d), algorithm="RSA", surface="source_code")[1]


@query(_with([*ctes("certs"), _CERTS], "SELECT cert_id, algorithm FROM ca WHERE purpose <> 'hashing'"))
def m07_certificates(spark: SparkSession, d: str) -> DataFrame:
    return X.certificate_assets(load(spark, d, "certs")).filter("purpose <> 'hashing'").select("cert_id", "algorithm")


@query(_with(ctes("scans"), "SELECT scan_id, status FROM scans WHERE user_id = 'u3' OR user_id IS NULL ORDER BY created_at DESC, ord DESC LIMIT 50"))
def m09_history(spark: SparkSession, d: str) -> DataFrame:
    return M.scan_history(load(spark, d, "scans"), "u3").select("scan_id", "status")


@query(_with(ctes("scans"), "SELECT scan_id, status FROM scans ORDER BY created_at DESC, ord DESC LIMIT 1"))
def m10_latest(spark: SparkSession, d: str) -> DataFrame:
    return M.latest_scan(load(spark, d, "scans"))


_LINES = ", ".join(f"({i}, '{k}', {c})" for i, (k, c) in enumerate((("total assets", "count(*)"), ("quantum vulnerable", "count(*) FILTER (priority <> 'P4')"), ("P1", "count(*) FILTER (priority = 'P1')"), ("P2", "count(*) FILTER (priority = 'P2')"), ("P3", "count(*) FILTER (priority = 'P3')"), ("P4", "count(*) FILTER (priority = 'P4')"), ("HNDL", "count(*) FILTER (hndl_flag)"), ("application", "count(*) FILTER (classification = 'application')"), ("infrastructure", "count(*) FILTER (classification = 'infrastructure')"))))


@query(_with([*_RISK, f"ln AS (SELECT unnest([{_LINES.replace('(', 'row(', 1).replace('), (', '), row(')}]) AS l FROM rk)"], "SELECT CAST(l[1] AS INT) AS line_no, concat(l[2], ': ', l[3]) AS line FROM ln"))
def m11_report(spark: SparkSession, d: str) -> DataFrame:
    return M.report_lines(scored(spark, d))


@query(_with(ctes("scans"), f"SELECT CASE WHEN status IN ('pending', 'running') AND created_at <= TIMESTAMP '{AS_OF}' - INTERVAL 30 MINUTE THEN 'failed' ELSE status END AS status, count(*) AS n FROM scans GROUP BY 1"))
def m15_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _n("status")(M.sweep_stale(load(spark, d, "scans"), AS_OF))


@query(_with(ctes("scans"), "SELECT scan_id, unnest(['pipeline_report', 'migration_report', 'certificate_report', 'cbom']) AS artifact FROM scans WHERE status = 'complete'"))
def m17_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return M.artifacts(load(spark, d, "scans"))


@query(_with(_BASE, "SELECT seq, purpose AS classification FROM findings"))
def m14_backfill(spark: SparkSession, d: str) -> DataFrame:
    x = findings(spark, d).select("seq", F.when(F.col("seq") % 2 == 0, F.col("purpose")).alias("classification"), F.to_json(F.struct(F.col("purpose").alias("classification"))).alias("asset_json"))
    return M.backfill(x, "classification").select("seq", "classification")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Priorities by classification over the deduplicated, classified and scored inventory."""
    return i06_priorities(spark, d)

"""Queries over components, edges, documents, pages, reports and whole runs, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import extract as X
from ..operators import inventory as I
from ..operators import reads as M
from ..operators import pages as P
from ..operators import reach as G
from ..operators import risk as K
from ..sources import tables as T
from . import rules as R
from . import run as runs
from .code_queries import _APPLIED, _FOUND, _MATCHED, _NAMED, _WALKS, cached, lines
from .fixtures import ctes, load
from .queries import _BASE, _CERTS, _CLASSED, _DEDUP, _KEY, _LEVEL, _MAPS, _MIG, _PAIRS, _REC, _REC2, _RECS, _REP, _RISK, _SYM, _WHEN, _YEARS, SCANNED, _n, _s, _scored, _with, findings, query, recommended, scored

_INFRA = "['TLS configuration', 'Certificate infrastructure']"
_PROTOCOLS = "pt(po, protocols) AS (VALUES " + ", ".join(f"({i}, [{', '.join(map(_s, m[10] or ()))}])" for i, m in enumerate(R.MAPPINGS)).replace("[]", "CAST([] AS VARCHAR[])") + ")"
_PARTS = [
    *_RECS,
    *_MIG,
    _PROTOCOLS,
    "k1 AS (SELECT mg.*, CASE WHEN seq % 3 = 0 THEN 'TLS 1.3' WHEN seq % 3 = 1 THEN 'QUIC' END AS protocol, CASE WHEN seq % 2 = 0 THEN 'openssl' END AS library, CASE WHEN rec_kind = 'migrate' THEN coalesce(protocols, []) ELSE [] END AS c0 FROM mg LEFT JOIN pt ON po = mapping_ord)",
    "k2 AS (SELECT *, c0 || CASE WHEN protocol IS NULL OR list_contains(c0, protocol) THEN [] ELSE [protocol] END AS c1 FROM k1)",
    "k3 AS (SELECT *, c1 || CASE WHEN library IS NULL THEN [] ELSE [library] END AS c2 FROM k2)",
    f"k4 AS (SELECT *, c2 || CASE WHEN classification = 'infrastructure' THEN {_INFRA} ELSE [] END AS c3 FROM k3)",
    "k5 AS (SELECT *, CASE WHEN len(c3) = 0 THEN [concat(source_surface, ' layer')] ELSE c3 END AS comps FROM k4)",
    "k6 AS (SELECT *, concat(algorithm, ' used for ', replace(purpose, '_', ' '), ' at ', file_path, ':', line_number, CASE WHEN protocol IS NULL THEN '' ELSE ' via ' || protocol END, CASE WHEN library IS NULL THEN '' ELSE ' (' || library || ')' END) AS current_state, CASE WHEN NOT urgency_flag AND NOT hndl_flag THEN concat('priority ', priority, ' — migration recommended') ELSE concat_ws('; ', CASE WHEN urgency_flag THEN concat('quantum-urgent (X=', x_years, 'yr + Y=', y_years, 'yr > Z=', z_years, 'yr threat timeline)') END, CASE WHEN hndl_flag THEN 'HNDL exposure: adversaries may already be harvesting ciphertext' END) END AS risk_context, concat('Migrate to ', rec_replacement, ' [', rec_status, '] via ', coalesce(rec_path, rec_path_type), ' strategy') AS action, " + f"{_LEVEL} AS impact_level, {_WHEN} AS migration_priority FROM k5)",
    "k7 AS (SELECT *, concat(current_state, ' → ', risk_context, ' → ', action, ' → affects: ', array_to_string(comps, ' + '), ' → migration priority: ', migration_priority, ' (impact: ', impact_level, ', composite score: ', format('{:.2f}', CAST(composite AS DOUBLE)), ')') AS narrative FROM k6)",
]


def migrated(spark: SparkSession, d: str) -> DataFrame:
    x = recommended(spark, d)
    m = F.col("seq") % 3
    return K.migration(x.withColumns({"protocol": F.when(m == 0, "TLS 1.3").when(m == 1, "QUIC"), "library": F.when(F.col("seq") % 2 == 0, "openssl")}))


# Migration


@query(_with(_PARTS, "SELECT seq, array_to_string(comps, '|') AS components FROM k7"))
def k06_components(spark: SparkSession, d: str) -> DataFrame:
    return migrated(spark, d).select("seq", F.array_join("components", "|").alias("components"))


@query(_with(_PARTS, "SELECT seq, narrative FROM k7"))
def k08_narratives(spark: SparkSession, d: str) -> DataFrame:
    return migrated(spark, d).select("seq", "narrative")


@query(_with(_RISK, "SELECT count(*) AS total, count(*) FILTER (priority = 'P1') AS p1, count(*) FILTER (priority = 'P2') AS p2, count(*) FILTER (hndl_flag) AS hndl FROM rk"))
def i09_priority_counts(spark: SparkSession, d: str) -> DataFrame:
    return K.priority_counts(scored(spark, d))


_STATUS = "CASE WHEN status = 'under_standardization' THEN status WHEN seq % 5 = 0 THEN 'draft' WHEN seq % 5 = 1 THEN 'classical' ELSE 'standardized' END"


@query(_with(_RECS, f"SELECT seq, CASE rec_kind WHEN 'unknown' THEN 'classical' ELSE CASE WHEN {_STATUS} = 'draft' THEN 'standardized' ELSE {_STATUS} END END AS rec_status, CASE WHEN rec_kind = 'migrate' AND seq % 7 = 0 THEN 'hybrid' ELSE rec_path_type END AS rec_path_type FROM re"))
def j05_coerced(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("seq")
    x = scored(spark, d).withColumns({"status": F.when(F.col("status") == "under_standardization", F.col("status")).when(s % 5 == 0, "draft").when(s % 5 == 1, "classical").otherwise("standardized"), "path_type": F.when(s % 7 == 0, "sideways").otherwise(F.col("path_type"))})
    return K.recommend(x).select("seq", "rec_status", "rec_path_type")


@query(_with([*_BASE, "u AS (SELECT unnest(['HQC', 'Falcon', 'BIKE']) AS name, unnest([0, 1, 2]) AS ord)"], "SELECT CAST(ord AS INT) AS ord, name, count(seq) AS findings FROM u LEFT JOIN findings f ON upper(f.algorithm) = upper(name) GROUP BY ALL"))
def j07_pending_names(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d).select(F.upper("algorithm").alias("_a"), "seq")
    return K.under_standardization(spark).join(f, F.upper("name") == F.col("_a"), "left").groupBy("ord", "name").agg(F.count("seq").alias("findings"))


# Completeness


@query(_with([*_BASE, "h AS (SELECT string_agg(c, ', ' ORDER BY c) AS m FROM (VALUES " + ", ".join(f"('{c}')" for c in R.CATEGORIES) + ") v(c) WHERE c NOT IN (SELECT purpose FROM findings))"], "SELECT 0 AS ord, 'Expected but not found: ' || m AS note FROM h WHERE m IS NOT NULL UNION ALL SELECT 1, 'Unscanned surfaces: infrastructure' UNION ALL SELECT 2, '4 files were skipped'"))
def h05_notes(spark: SparkSession, d: str) -> DataFrame:
    return M.completeness_notes(findings(spark, d), SCANNED, files_skipped=4)


# Edges, components, documents


_EDGE = [*_SYM, _REP[-1], "ie AS (SELECT a.seq AS f, b.seq AS t, 'source_invokes' AS kind, 2 AS o, concat('sibling symbol ''', a.sib, ''' in same statement') AS evidence, row_number() OVER (PARTITION BY a.seq ORDER BY b.r) AS k FROM sy a JOIN sy b ON b.own = a.sib AND a.own <> a.sib WHERE a.source_surface = 'source_code' AND contains(a.snippet, a.sib) AND b.r <= 8)", "xe AS (SELECT a.seq AS f, b.seq AS t, 'cross_surface' AS kind, 3 AS o, concat('family ', a.family, ' on ', a.source_surface, ' and ', b.source_surface) AS evidence, 0 AS k FROM rp a JOIN rp b ON a.family = b.family AND a.source_surface < b.source_surface)", "ae AS (SELECT * FROM ie UNION ALL SELECT * FROM xe)", "de AS (SELECT f, t, kind, evidence, o, k FROM (SELECT *, row_number() OVER (PARTITION BY f, t ORDER BY o, k) AS n FROM ae) WHERE n = 1)", "le AS (SELECT f AS from_id, t AS to_id, kind, left(evidence, 300) AS evidence, row_number() OVER (PARTITION BY f ORDER BY o, k, t) AS rank FROM de)"]


def edges(spark: SparkSession, d: str) -> DataFrame:
    nxt = F.concat(F.lit("R-"), ((F.substring("rule_id", 3, 9).cast("int") + 1) % 19).cast("string"))
    a = I.deduplicate(findings(spark, d))
    s = a.withColumns({"observed_symbol": F.col("rule_id"), "sibling_symbols": F.array(F.col("rule_id"), nxt), "snippet": F.when(F.col("seq") % 4 == 0, "nothing").otherwise(F.concat(F.lit("call "), nxt, F.lit("()")))})
    cross = M.cross_surface_edges(a).drop("family").withColumn("_k", F.lit(0))
    return M.linked(M.invokes_edges(s).withColumnRenamed("k", "_k").unionByName(cross))


@query(_with(_EDGE, "SELECT from_id, to_id, kind, evidence, CAST(rank AS INT) AS rank FROM le WHERE rank <= 8"))
def l04_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d)


_PROPS = (
    ("location", "concat(file_path, ':', line_number)"), ("purpose", "purpose"), ("classification", "classification"), ("sensitivity", "sensitivity"), ("business_criticality", "criticality"), ("source_surface", "source_surface"), ("protocol", "protocol"), ("library", "library"), ("evidence.rule_id", "rule_id"),
    ("evidence.confidence", "format('{:.4f}', confidence)"), ("risk.priority", "priority"), ("risk.urgency", "CASE WHEN urgency_flag THEN 'True' ELSE 'False' END"), ("risk.hndl", "CASE WHEN hndl_flag THEN 'True' ELSE 'False' END"), ("risk.mosca_x", "format('{:.1f}', CAST(x_years AS DOUBLE))"), ("risk.mosca_y", "format('{:.1f}', CAST(y_years AS DOUBLE))"), ("risk.mosca_z", "format('{:.1f}', CAST(z_years AS DOUBLE))"),
    ("recommendation.replacement", "rec_replacement"), ("recommendation.migration_path", "rec_path"), ("recommendation.status", "rec_status"), ("migration.priority", "migration_priority"), ("migration.impact_level", "impact_level"), ("migration.score", "format('{:.3f}', CAST(composite AS DOUBLE))"), ("migration.narrative", "left(narrative, 500)"),
)
_PRIMITIVE = "CASE purpose " + " ".join(f"WHEN '{p}' THEN '{v}'" for p, v in R.PRIMITIVES) + " ELSE 'unknown' END"
_NAME = "CASE WHEN source_surface = 'certificate' AND seq % 2 = 0 THEN concat('host', seq % 9) ELSE algorithm END"
_ABOUT = "CASE WHEN source_surface = 'certificate' THEN concat('X.509 certificate — ', algorithm, ' (', replace(purpose, '_', ' '), ')') ELSE concat(algorithm, ' (', replace(purpose, '_', ' '), ') — ', classification, ' cryptography') END"


def parts(spark: SparkSession, d: str) -> DataFrame:
    subject = F.when((F.col("source_surface") == "certificate") & (F.col("seq") % 2 == 0), F.concat(F.lit("O=x, CN=host"), (F.col("seq") % 9).cast("string")))
    return M.components(migrated(spark, d).withColumn("certificate_subject", subject))


@query(_with(_PARTS, f"SELECT seq, {_NAME} AS name, {_ABOUT} AS description, CASE WHEN source_surface = 'certificate' THEN 'certificate' ELSE 'algorithm' END AS asset_type, CASE WHEN source_surface <> 'certificate' THEN {_PRIMITIVE} END AS primitive FROM k7"))
def l06_components(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("seq", "component.name", "component.description", F.col("component.assetType").alias("asset_type"), "component.primitive")


@query(_with(_PARTS, "SELECT seq, array_to_string(list_filter([" + ", ".join(f"'inventory:{k}=' || {v}" for k, v in _PROPS) + "], lambda x: x IS NOT NULL), chr(10)) AS properties FROM k7"))
def l07_properties(spark: SparkSession, d: str) -> DataFrame:
    return parts(spark, d).select("seq", F.array_join(F.transform("component.properties", lambda p: F.concat(p["name"], F.lit("="), p["value"])), "\n").alias("properties"))


@query(_with([*_EDGE, "p AS (SELECT from_id, list(DISTINCT to_id ORDER BY to_id) AS t FROM le WHERE rank <= 8 GROUP BY 1)"], "SELECT section, count(*) AS n, count(*) FILTER (starts_with(line, ',')) AS separated, coalesce(sum(length(line)) FILTER (section = 3), 0) AS chars FROM (SELECT 0 AS section, '{' AS line UNION ALL SELECT 2, ']' UNION ALL SELECT 4, ']' UNION ALL SELECT 1, CASE WHEN seq = (SELECT min(seq) FROM dd) THEN '{' ELSE ',' END FROM dd UNION ALL SELECT 3, concat(CASE WHEN from_id = (SELECT min(from_id) FROM p) THEN '' ELSE ',' END, '{\"ref\":\"', from_id, '\",\"dependsOn\":[', array_to_string(list_transform(t, lambda x: '\"' || x || '\"'), ','), ']}') FROM p) GROUP BY 1"))
def l08_document(spark: SparkSession, d: str) -> DataFrame:
    a = I.deduplicate(findings(spark, d))
    text = M.document(parts(spark, d), M.dependencies(edges(spark, d), a), "scan1", "2024-02-01T00:00:00Z")
    chars = F.coalesce(F.sum(F.when(F.col("section") == 3, F.length("line"))), F.lit(0))
    return text.groupBy("section").agg(F.count("*").alias("n"), F.count_if(F.col("line").startswith(",")).alias("separated"), chars.alias("chars"))


_VERSION = lambda name, keep, z: [f"{name}d AS (SELECT * FROM (SELECT *, row_number() OVER ({_KEY} ORDER BY confidence DESC, seq) AS rn FROM findings WHERE seq % 10 <> {keep}) WHERE rn = 1)", *[x.replace("FROM dd", f"FROM {name}d").replace("c1 AS", f"{name}1 AS").replace("FROM c1", f"FROM {name}1").replace("c2 AS", f"{name}2 AS").replace("FROM c2", f"FROM {name}2").replace("cl AS", f"{name}c AS") for x in _CLASSED[1:]], *_scored(z, f"{name}c", f"{name}k"), _REC.replace("rc AS", f"{name}r AS").replace("FROM rk", f"FROM {name}k"), _REC2.replace("re AS", f"{name}e AS").replace("FROM rc", f"FROM {name}r")]
_TWO = [*_BASE, *_CLASSED, _MAPS, _YEARS, *_PAIRS, *_VERSION("va", 0, "10"), *_VERSION("vb", 1, "15")]


@query(_with(_TWO, "SELECT CAST(coalesce(o.seq, n.seq) AS VARCHAR) AS asset_id, CASE WHEN o.seq IS NULL THEN 'new' WHEN n.seq IS NULL THEN 'removed' ELSE 'changed' END AS change FROM vae o FULL JOIN vbe n ON o.seq = n.seq WHERE o.seq IS NULL OR n.seq IS NULL OR o.algorithm <> n.algorithm OR o.purpose <> n.purpose OR o.priority IS DISTINCT FROM n.priority OR o.rec_replacement IS DISTINCT FROM n.rec_replacement"))
def l10_version_diff(spark: SparkSession, d: str) -> DataFrame:
    f = findings(spark, d)
    version = lambda keep, z: K.recommend(K.score(C.classify(I.deduplicate(f.filter(F.col("seq") % 10 != keep))), z)).withColumn("asset_id", F.col("seq").cast("string"))
    return M.version_diff(version(0, 10), version(1, 15))


# Reads

_SCAN = "concat('scan', line_number % 3)"


def by_scan(x: DataFrame) -> DataFrame:
    return x.withColumn("scan_id", F.concat(F.lit("scan"), (F.col("line_number") % 3).cast("string")))


@query(_with(_RISK, f"SELECT {_SCAN} AS scan_id, count(*) AS asset_count, count(*) FILTER (source_surface = 'certificate') AS certificate_asset_count, count(*) FILTER (hndl_flag) AS hndl_count, concat_ws(','" + "".join(f", count(*) FILTER (source_surface = '{s}')" for s in R.SURFACES) + ") AS surfaces, concat_ws(','" + "".join(f", count(*) FILTER (priority = '{p}')" for p in R.PRIORITIES) + ") AS priorities FROM rk GROUP BY 1"))
def m01_scan_summary(spark: SparkSession, d: str) -> DataFrame:
    told = lambda c, names: F.concat_ws(",", *[F.col(c)[n].cast("string") for n in names])
    x = M.scan_summary(by_scan(scored(spark, d)))
    return x.select("scan_id", "asset_count", "certificate_asset_count", "hndl_count", told("surface_counts", R.SURFACES).alias("surfaces"), told("priority_counts", R.PRIORITIES).alias("priorities"))


@query(_with([*_RISK, "h AS (SELECT count(*) FILTER (c IN (SELECT purpose FROM dd)) AS f FROM (VALUES " + ", ".join(f"('{c}')" for c in R.CATEGORIES) + ") v(c))"], "SELECT count(*) AS total, count(*) FILTER (priority = 'P1') AS p1, (SELECT round(0.3 * 80.0 + 0.7 * 100.0 * f / 7.0, 1) FROM h) AS coverage_pct FROM rk"))
def m03_coverage(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    return M.dashboard(s, M.completeness(s, SCANNED)).select("total", "p1", "coverage_pct")


@query(_with(_RISK, "SELECT seq, file_path, line_number FROM rk WHERE priority = 'P1' ORDER BY file_path, line_number, seq LIMIT 10"))
def m04_top_p1(spark: SparkSession, d: str) -> DataFrame:
    return M.top_findings(scored(spark, d), 10).select("seq", "file_path", "line_number")


@query(_with(_RISK, "SELECT seq, priority FROM rk ORDER BY priority, file_path, line_number, seq LIMIT 100 OFFSET 250"))
def m05_risk_page(spark: SparkSession, d: str) -> DataFrame:
    return M.risk_page(scored(spark, d), limit=100, offset=250).select("seq", "priority")


def _ranges(spark: SparkSession, d: str, x: DataFrame, order: tuple) -> P.Ranges:
    return P.write_ranges(x, order, f"{G.scratch(spark)}/pages-{uuid.uuid4().hex}", 500)


@query(_with(_RISK, "SELECT seq, algorithm, priority, (SELECT count(*) FROM rk WHERE source_surface = 'source_code') AS total FROM rk WHERE source_surface = 'source_code' ORDER BY priority, seq LIMIT 300 OFFSET 700"))
def m02_deep_page(spark: SparkSession, d: str) -> DataFrame:
    """A page that spans ranges, read from the table in ranges; the total comes from its counts."""
    x = _ranges(spark, d, M.matching(scored(spark, d), surface="source_code"), M.page_order("priority"))
    return x.page(300, 700).select("seq", "algorithm", "priority", F.lit(x.total).cast("long").alias("total"))


@query(_with(_RISK, "SELECT seq, priority FROM rk ORDER BY coalesce(priority, 'P5'), file_path, line_number, seq LIMIT 100 OFFSET 1250"))
def m05_deep_page(spark: SparkSession, d: str) -> DataFrame:
    return _ranges(spark, d, scored(spark, d), M.risk_order()).page(100, 1250).select("seq", "priority")


_JUDGED = "j AS (SELECT *, CASE WHEN seq % 3 = 0 THEN true WHEN seq % 3 = 1 THEN false END AS reachable FROM dd)"


@query(_with([*_BASE, _DEDUP, _JUDGED, "sm AS (SELECT count(*) AS total, count(*) FILTER (reachable) AS n_reachable, count(*) FILTER (NOT reachable) AS n_unreachable, count(*) FILTER (reachable IS NULL) AS n_unknown FROM j)"], "SELECT seq, file_path, reachable, total, n_reachable, n_unreachable, n_unknown FROM j, sm ORDER BY file_path, line_number, seq LIMIT 75 OFFSET 225"))
def m06_reachability_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of assets with the summary of all verdicts in each row."""
    r = F.col("seq") % 3
    x = I.deduplicate(findings(spark, d)).withColumn("reachable", F.when(r == 0, True).when(r == 1, False))
    rows, summary = M.reachability_page(x, G.report(x), limit=75, offset=225)
    told = summary.select("total", *[F.col(c).alias(f"n_{c}") for c in ("reachable", "unreachable", "unknown")])
    return rows.select("seq", "file_path", "reachable").crossJoin(F.broadcast(told))


@query(_with(_RISK, "SELECT seq, algorithm, (SELECT count(*) FROM rk WHERE source_surface = 'certificate') AS total FROM rk WHERE source_surface = 'certificate' ORDER BY file_path, line_number, seq LIMIT 60 OFFSET 30"))
def m07_certificate_page(spark: SparkSession, d: str) -> DataFrame:
    rows, total = M.certificate_page(scored(spark, d), limit=60, offset=30)
    return rows.select("seq", "algorithm").crossJoin(F.broadcast(total))


@query(_with(_PARTS, f"SELECT seq, {_NAME} AS name, {_ABOUT} AS description, CASE WHEN source_surface <> 'certificate' THEN {_PRIMITIVE} END AS primitive FROM k7 WHERE {_SCAN} = 'scan1'"))
def m19_reexport(spark: SparkSession, d: str) -> DataFrame:
    """A stored scan's document in XML, written anew and read back component by component."""
    base = f"{G.scratch(spark)}/stored-{uuid.uuid4().hex}"
    subject = F.when((F.col("source_surface") == "certificate") & (F.col("seq") % 2 == 0), F.concat(F.lit("O=x, CN=host"), (F.col("seq") % 9).cast("string")))
    T.write_assets(by_scan(migrated(spark, d).withColumn("certificate_subject", subject)), f"{base}/assets")
    text, _ = M.reexport(T.read_assets(spark, f"{base}/assets"), "scan1", "2024-02-01T00:00:00Z", "xml")
    T.write_document(text, f"{base}/document")
    fields = "bomRef long, name string, description string, primitive string"
    return T.read_components(spark, f"{base}/document", fields).select(F.col("bomRef").alias("seq"), "name", "description", "primitive")


@query(_with([*_BASE, _DEDUP], "SELECT count(*) AS total, CAST(0 AS BIGINT) AS reachable, CAST(0 AS BIGINT) AS unreachable, count(*) AS unknown, CAST(0.0 AS DOUBLE) AS rate FROM dd"))
def m06_reachability_default(spark: SparkSession, d: str) -> DataFrame:
    return M.reachability_page(I.deduplicate(findings(spark, d)), None)[1]


@query(_with(_PARTS, f"SELECT {_SCAN} AS scan_id, seq, priority, algorithm, migration_priority, composite FROM k7 WHERE seq % 2 = 0"))
def m08_roadmaps(spark: SparkSession, d: str) -> DataFrame:
    m = by_scan(migrated(spark, d))
    stored = m.filter("seq % 2 = 0").select("scan_id", "seq", "migration_priority", "composite")
    return M.roadmaps(m.select("scan_id", "seq", "priority", "algorithm"), stored)


_REPORT = "unnest([concat(algorithm, ' [', priority, ']'), concat('  Location : ', file_path, ':', line_number), concat('  Current  : ', current_state), concat('  Risk     : ', risk_context), concat('  Action   : ', action), concat('  Priority : ', migration_priority), concat('  Impact   : ', format('{:.4f}', CAST(composite AS DOUBLE)), ' (', impact_level, ')'), concat('  Affected : ', array_to_string(comps, ', ')), '  Validate :'] || list_transform(string_split(CASE rec_path_type " + " ".join(f"WHEN '{k}' THEN {_s('|'.join(v))}" for k, v in R.STEPS) + f" ELSE {_s('|'.join(R.STEPS[0][1]))} END, '|'), lambda x: '    - ' || x) || [''])"


@query(_with([*_PARTS, f"ln AS (SELECT seq, CAST(substr(priority, 2, 1) AS BIGINT) AS rank, {_REPORT} AS line FROM k7)"], "SELECT rank, seq, line FROM ln"))
def m12_migration_report(spark: SparkSession, d: str) -> DataFrame:
    return M.migration_report(migrated(spark, d)).select("rank", "seq", "line")


@query(_with([*_BASE, _DEDUP], "SELECT seq, concat('  ', file_path, ':', line_number, ' ', algorithm) AS line FROM dd"))
def m11_asset_lines(spark: SparkSession, d: str) -> DataFrame:
    return M.asset_lines(I.deduplicate(findings(spark, d))).select("seq", "line")


_STAGE = "CASE WHEN days_to_expiry < 0 THEN 'expired' WHEN days_to_expiry <= 90 THEN 'rotation_pending' ELSE 'active' END"


@query(_with([*ctes("certs"), _CERTS, "cr AS (SELECT ca.*, c.file_path, c.subject, c.days_to_expiry FROM ca JOIN certs c USING (cert_id))"], f"SELECT cert_id, unnest([concat(algorithm, ' [Unscored]'), concat('  Location : ', file_path), concat('  Subject  : ', subject), '  Issuer   : None', concat('  Expiry   : ', days_to_expiry, ' days'), concat('  Lifecycle: ', {_STAGE}), '  Owner    : unassigned', '']) AS line FROM cr"))
def m13_certificate_report(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    c = X.certificate_assets(load(spark, d, "certs")).withColumns({"seq": F.col("cert_id"), "certificate_subject": F.col("subject"), "certificate_issuer": none, "certificate_expiry": F.concat(F.col("days_to_expiry").cast("string"), F.lit(" days")), "lifecycle_stage": C.certificate_stage(F.col("days_to_expiry")), "owner": none, "priority": none})
    return M.certificate_report(c).select(F.col("seq").alias("cert_id"), "line")


@query(_with([*_RISK, *ctes("scans")], f"SELECT scan_id, count(*) AS n, min(ord) AS first, sum(length(algorithm)) AS chars FROM (SELECT 'scan' || (o % 3) AS scan_id, 0 AS ord, '' AS algorithm FROM range(3) t(o) WHERE 'scan' || o IN ('scan0', 'scan1') UNION ALL SELECT {_SCAN}, seq + 1, algorithm FROM rk WHERE line_number % 3 < 2) GROUP BY 1"))
def m18_bill_payload(spark: SparkSession, d: str) -> DataFrame:
    a = by_scan(scored(spark, d))
    scans = a.select("scan_id").distinct().withColumn("status", F.lit("complete"))
    bills = scans.filter("scan_id <> 'scan2'").select("scan_id", F.lit(1).alias("component_count"), F.lit("json").alias("format"))
    p = M.bill_payload(scans, bills, a)
    return p.groupBy("scan_id").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.sum(F.length(F.coalesce(F.get_json_object("payload", "$.algorithm"), F.lit("")))).alias("chars"))


@query(_with([*ctes("observed")], "SELECT scan_id, count(*) AS total, count(*) FILTER (finding_type <> 'llm_enriched' AND purpose = 'unknown' AND length(snippet) > 0) AS eligible, count(*) FILTER (finding_type = 'llm_enriched') AS enriched FROM observed GROUP BY 1"))
def e13_enrichment_status(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.enrich import ambiguous

    return M.enrichment_status(load(spark, d, "observed").withColumn("ambiguous", ambiguous()))


@query(_with([*_APPLIED, *[x.replace("FROM dd", "FROM ae") for x in _CLASSED[1:]], _MAPS, _YEARS, *_PAIRS, *_scored(), _REC, _REC2, *_MIG], f"SELECT purpose, priority, rec_kind, {_WHEN} AS migration_priority, count(*) AS n FROM mg GROUP BY ALL"))
def e14_rerun(spark: SparkSession, d: str) -> DataFrame:
    x = runs.rerun_after_enrichment(load(spark, d, "observed"), cached(spark, d))
    return _n("purpose", "priority", "rec_kind", "migration_priority")(x)


# Whole runs


_REACHED = [
    *_WALKS,
    *_MATCHED,
    "mq AS (SELECT l.file_path, l.line_no, (SELECT arg_max(qualified_name, (start_line, qualified_name)) FROM fu WHERE fu.file_path = l.file_path AND start_line <= l.line_no) AS function FROM source_lines l)",
    "rn AS (SELECT node, min(depth) AS depth FROM wa WHERE source IN (SELECT qualified_name FROM fu WHERE reason IS NOT NULL) GROUP BY 1)",
    f"mr AS (SELECT {_NAMED} AS algorithm, purpose, file_path, line_no FROM mm GROUP BY ALL)",
]


@query(_with(_REACHED, "SELECT algorithm, purpose, function, CASE WHEN function IS NULL THEN NULL ELSE depth IS NOT NULL END AS reachable, count(*) AS n FROM mr JOIN mq USING (file_path, line_no) LEFT JOIN rn ON node = function GROUP BY ALL"))
def m20_run(spark: SparkSession, d: str) -> DataFrame:
    """The whole run, with no stage left out: verdicts and the functions behind them."""
    out = runs.run(lines(spark, d))
    if out.status != "complete" or out.assets is None:
        raise RuntimeError(f"{out.failed}: {out.error}")
    return _n("algorithm", "purpose", "function", "reachable")(out.assets)


_RUN_SQL = [
    *_FOUND,
    f"rs AS (SELECT {_NAMED} AS algorithm, purpose, file_path, line_no, 'source_code' AS source_surface FROM mm GROUP BY ALL)",
    *ctes("findings"),
    "ow AS (SELECT *, CASE WHEN seq % 3 = 0 THEN concat('o', seq % 7) END AS owner FROM findings WHERE source_surface = 'certificate')",
    f"ob AS (SELECT *, max(confidence) OVER ({_KEY} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ow)",
    "wn AS (SELECT upper(algorithm) AS a, arg_max(owner, seq) FILTER (owner IS NOT NULL) AS owner FROM ob WHERE m IS NULL OR confidence > m GROUP BY upper(algorithm), purpose, file_path, line_number)",
]


@query(_with(_RUN_SQL, "SELECT 'certificate' AS surface, owner, count(*) AS n FROM wn GROUP BY ALL UNION ALL SELECT 'source_code', NULL, count(*) FROM rs"))
def d03_in_run(spark: SparkSession, d: str) -> DataFrame:
    """A whole run whose certificates carry owners: winners take over the owner of what they displace."""
    x = findings(spark, d).filter("source_surface = 'certificate'").drop("source_surface")
    x = x.withColumn("owner", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("o"), (F.col("seq") % 7).cast("string"))))
    out = runs.run(lines(spark, d), {"certificate": x}, skip=("reachability",))
    if out.status != "complete" or out.assets is None:
        raise RuntimeError(f"{out.failed}: {out.error}")
    return out.assets.groupBy(F.col("source_surface").alias("surface"), "owner").agg(F.count("*").alias("n"))


@query(_with(_FOUND, f"SELECT algorithm, purpose, count(*) AS n FROM (SELECT {_NAMED} AS algorithm, purpose, file_path, line_no FROM mm GROUP BY ALL) GROUP BY ALL"))
def m16_partial_run(spark: SparkSession, d: str) -> DataFrame:
    """The run with a last stage that fails while it is written: rows and stages up to it stay."""
    out = runs.run(lines(spark, d), skip=("reachability",), more={"export": lambda a: a.withColumn("sent", F.raise_error(F.lit("no place to export to")).cast("string"))})
    if out.status != "partial" or out.failed != "export" or out.assets is None:
        raise RuntimeError(f"expected a partial run, got {out.status}")
    return _n("algorithm", "purpose")(out.assets)


# Rule tables of a user

#: (surfaces, purposes, prefixes, paths, classification, result, description, key size below, key size at least), as load_classification() gives them.
_USER_CLASSES = ((None, None, ("RSA", "ECD"), ("pay", "auth"), None, "infrastructure", "money", None, None), (("binary",), ("hashing",), None, None, None, "secret", "no such class", None, None), (None, None, None, None, None, "application", "all", None, None))
_USER_SHELF = (("infrastructure", "internal", 4), ("application", "internal", 6), ("application", "high", 9))
_USER_WEIGHTS = (0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.2)
_BEST = lambda name, table, pattern, purpose, wild, bonus: f"{name} AS (SELECT algorithm, purpose, ord FROM (SELECT a.algorithm, a.purpose, ord, row_number() OVER (PARTITION BY a.algorithm, a.purpose ORDER BY CASE WHEN {pattern} = '*' THEN 0 ELSE length({pattern}) END + CASE WHEN m.{purpose} = '{wild}' THEN 0 ELSE {bonus} END DESC, ord) AS r FROM ap a JOIN {table} m ON (m.{purpose} = '{wild}' OR m.{purpose} = a.purpose) AND ({pattern} = '*' OR starts_with(upper(a.algorithm), upper({pattern})))) WHERE r = 1)"
_USER = [
    *ctes("findings", "user_mappings", "user_years", "user_impacts"),
    _CLASSED[0],
    "cl AS (SELECT *, CASE WHEN (starts_with(upper(algorithm), 'RSA') OR starts_with(upper(algorithm), 'ECD')) AND (contains(file_path, 'pay') OR contains(file_path, 'auth')) THEN 'infrastructure' ELSE 'application' END AS classification, CASE WHEN (starts_with(upper(algorithm), 'RSA') OR starts_with(upper(algorithm), 'ECD')) AND (contains(file_path, 'pay') OR contains(file_path, 'auth')) THEN 'money' WHEN source_surface = 'binary' AND purpose = 'hashing' THEN 'invalid rule result' ELSE 'all' END AS classification_rule, 'internal' AS sensitivity FROM dd)",
    "ap AS (SELECT DISTINCT algorithm, purpose FROM cl)",
    _BEST("bm", "user_mappings", "pattern", "map_purpose", "any", 1000),
    _BEST("yy", "user_years", "pattern", "migration_type", "*", 100),
    _BEST("im", "user_impacts", "prefix", "purpose", "*", 100),
    "u0 AS (SELECT c.*, m.ord AS mapping_ord, coalesce(m.vulnerable, true) AS v, coalesce(m.broken, false) AS b, coalesce(m.weakened, false) AS w, CASE WHEN c.classification = 'infrastructure' THEN 4 ELSE 6 END AS x, coalesce(y.years, 2) AS y, i.score FROM cl c LEFT JOIN bm USING (algorithm, purpose) LEFT JOIN user_mappings m ON m.ord = bm.ord LEFT JOIN yy ON yy.algorithm = c.algorithm AND yy.purpose = c.purpose LEFT JOIN user_years y ON y.ord = yy.ord LEFT JOIN im ON im.algorithm = c.algorithm AND im.purpose = c.purpose LEFT JOIN user_impacts i ON i.ord = im.ord)",
    "u1 AS (SELECT *, x + y > 12 AS urgent, CASE WHEN purpose IN ('hashing', 'mac', 'random_generation', 'key_derivation') OR NOT v THEN false WHEN purpose IN ('key_establishment', 'encryption') THEN x >= 5 WHEN purpose = 'digital_signature' THEN x >= 6 ELSE false END AS harvest FROM u0)",
    "us AS (SELECT *, CASE WHEN b THEN 'P1' WHEN NOT v AND NOT w THEN 'P4' WHEN NOT v THEN 'P3' WHEN urgent AND harvest THEN 'P1' WHEN urgent OR harvest THEN 'P2' ELSE 'P3' END AS priority FROM u1)",
]


def _user_classes(spark: SparkSession, d: str) -> DataFrame:
    deduplicated = I.deduplicate(load(spark, d, "findings"))
    return C.classify(deduplicated, {"classification": _USER_CLASSES, "sensitivity": ((None, None, None, None, None, "internal", "all"),)})


def _user_scored(spark: SparkSession, d: str) -> DataFrame:
    return K.score(_user_classes(spark, d), 12, mappings=load(spark, d, "user_mappings").withColumn("alternative", F.lit(None).cast("string")).withColumn("protocols", F.lit(None).cast("array<string>")), years=load(spark, d, "user_years"), shelf_life=_USER_SHELF, harvest=(5, 6))


@query(_with(_USER, "SELECT seq, classification, classification_rule FROM us"))
def a06_user_classes(spark: SparkSession, d: str) -> DataFrame:
    return _user_classes(spark, d).select("seq", "classification", "classification_rule")


@query(_with(_USER, "SELECT seq, CAST(mapping_ord AS INT) AS mapping_ord, CAST(x AS INT) AS x_years, CAST(y AS INT) AS y_years, priority FROM us"))
def a07_user_mappings(spark: SparkSession, d: str) -> DataFrame:
    return _user_scored(spark, d).select("seq", F.col("mapping_ord").cast("int").alias("mapping_ord"), "x_years", F.col("y_years").cast("int").alias("y_years"), "priority")


@query(_with(_USER, "SELECT seq, round(least(1.0, CASE WHEN score IS NULL THEN 0.4 * 0.2 + 0.3 * 0.1 + 0.3 * 0.1 + 0.5 * 0.1 + 0.5 * 0.1 + 0.3 * 0.1 + 0.4 * 0.1 + 0.4 * 0.2 ELSE CAST(score AS DOUBLE) END), 4) AS composite FROM us"))
def a09_user_impacts(spark: SparkSession, d: str) -> DataFrame:
    impacts = load(spark, d, "user_impacts").select("ord", "prefix", "purpose", F.map_from_arrays(F.array(*[F.lit(f) for f in R.FACTORS]), F.array_repeat(F.col("score").cast("double"), len(R.FACTORS))).alias("scores"))
    return K.migration(K.recommend(_user_scored(spark, d)), impacts=impacts, weights=_USER_WEIGHTS).select("seq", "composite")


#: Over MAX_COMPILED patterns, so those with a literal are found by its first letters.
_MANY = (*R.FINGERPRINTS, *((f"U-{i}", f"EVP_(sha|aes)_?{i}", "user", "hashing", 0.5) for i in range(300)), ("U-any", "R.A|5_I", "any", "hashing", 0.5))
_MANY_SQL = "fp(rule_id, pattern, algorithm) AS (VALUES " + ", ".join(f"({_s(r)}, {_s(p)}, {_s(a)})" for r, p, a, _, _ in _MANY) + ")"


@query(_with([*ctes("blobs"), _MANY_SQL], "SELECT file_path, rule_id, arg_min(s, pos) AS observed, any_value(algorithm) AS algorithm FROM blobs JOIN fp ON regexp_matches(s, pattern, 'i') GROUP BY ALL"))
def a03_many_patterns(spark: SparkSession, d: str) -> DataFrame:
    return X.match_strings(load(spark, d, "blobs"), _MANY).select("file_path", "rule_id", "observed", "algorithm")


_NEW_SUITES = (("N-1", "gcm.*384$", "AES-256", "encryption", 0.9), ("N-2", "^tls_", "TLS", "key_establishment", 0.9), ("N-3", "rc4", "RC4", "encryption", 0.8))


@query(_with(ctes("handshakes"), "SELECT event_id, CASE WHEN regexp_matches(cipher_suite, 'gcm.*384$', 'i') THEN 'N-1' WHEN regexp_matches(cipher_suite, '^tls_', 'i') THEN 'N-2' ELSE 'N-3' END AS rule_id FROM handshakes WHERE regexp_matches(cipher_suite, 'gcm.*384$|^tls_|rc4', 'i')"))
def a05_user_suites(spark: SparkSession, d: str) -> DataFrame:
    return X.match_ciphers(load(spark, d, "handshakes"), R.fingerprint_table(spark, _NEW_SUITES)).select("event_id", "rule_id")

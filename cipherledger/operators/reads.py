"""Completeness, relationships, components, quality, version diff and reads of the asset table."""

from __future__ import annotations

import json
import re
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import rules as R
from .inventory import family_of
from .risk import fixed


def surface_coverage(assets: DataFrame, scanned: tuple[str, ...], unavailable: tuple[str, ...] = ()) -> DataFrame:
    """A row for each surface: scanned, skipped (not asked for) or unavailable (its reader is missing), and its assets."""
    state = lambda s: "unavailable" if s in unavailable else "scanned" if s in scanned else "skipped"
    dim = assets.sparkSession.createDataFrame([(s, state(s), s in scanned and s not in unavailable) for s in R.SURFACES], "surface string, state string, scanned boolean")
    n = assets.groupBy(F.col("source_surface").alias("surface")).agg(F.count("*").alias("n"))
    return dim.join(n, "surface", "left").select("surface", "state", "scanned", F.coalesce("n", F.lit(0)).alias("assets_found"))


def category_coverage(assets: DataFrame, expected: tuple[str, ...] = R.CATEGORIES) -> DataFrame:
    """Known and found categories with their algorithms, each once and in order; algorithms are distinct before they are gathered."""
    dim = assets.sparkSession.createDataFrame([(c, c in expected) for c in dict.fromkeys((*R.CATEGORIES, *expected))], "category string, expected boolean")
    kinds = assets.groupBy(F.col("purpose").alias("category"), "algorithm").agg(F.count("*").alias("n"))
    n = kinds.groupBy("category").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("algorithm")).alias("algorithms"))
    out = dim.join(n, "category", "full_outer")
    none = F.array().cast("array<string>")
    return out.select("category", F.coalesce("expected", F.lit(False)).alias("expected"), F.col("n").isNotNull().alias("found"), F.coalesce("n", F.lit(0)).alias("asset_count"), F.coalesce("algorithms", none).alias("algorithms"))


def completeness_notes(assets: DataFrame, scanned: tuple[str, ...], files_skipped: int = 0, expected: tuple[str, ...] = R.CATEGORIES) -> DataFrame:
    """(ord, note): what a reader should know of a scan's gaps; no rows where there are none."""
    c = completeness(assets, scanned, expected).crossJoin(F.broadcast(assets.agg(F.count("*").alias("_n"))))
    space = lambda col: F.replace(col, F.lit(","), F.lit(", "))
    notes = [
        F.when(F.col("missing_categories") != "", F.concat(F.lit("Expected but not found: "), space("missing_categories"))),
        F.when(F.col("unscanned_surfaces") != "", F.concat(F.lit("Unscanned surfaces: "), space("unscanned_surfaces"))),
        F.when(F.lit(files_skipped > 0), F.lit(f"{files_skipped} files were skipped")),
        F.when(F.lit(len(set(scanned)) < 2), F.lit("Only one input surface was scanned")),
        F.when(F.col("_n") == 0, F.lit("No cryptographic assets were discovered")),
    ]
    return c.select(F.posexplode(F.array(*notes)).alias("ord", "note")).filter("note IS NOT NULL")


def completeness(assets: DataFrame, scanned: tuple[str, ...], expected: tuple[str, ...] = R.CATEGORIES) -> DataFrame:
    """One row: percentages to 1 place, and the gaps."""
    c = category_coverage(assets, expected).agg(F.count_if(F.col("expected") & F.col("found")).alias("hit"), F.count_if("expected").alias("want"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("expected") & ~F.col("found"), F.col("category")))), ",").alias("missing_categories"))
    surfaces = F.lit(100.0 * len(set(scanned) & set(R.SURFACES)) / len(R.SURFACES))
    categories = F.when(F.col("want") > 0, 100.0 * F.col("hit") / F.col("want")).otherwise(100.0)
    gaps = ",".join(sorted(set(R.SURFACES) - set(scanned)))
    return c.select(F.round(surfaces, 1).alias("surface_pct"), F.round(categories, 1).alias("category_pct"), F.round(0.3 * surfaces + 0.7 * categories, 1).alias("overall_pct"), "missing_categories", F.lit(gaps).alias("unscanned_surfaces"))


#: Edges that one source may have, and characters of an edge's evidence.
EDGES, EVIDENCE = 8, 300
#: Order of kinds where a source has too many edges.
EDGE_KINDS = ("cert_uses_key", "cert_signed_with", "source_invokes", "cross_surface")


def certificate_edges(cert_assets: DataFrame) -> DataFrame:
    """Edges inside a certificate: hashing uses the key, the key is signed with the hash. Only the certificate surface counts."""
    own = cert_assets.filter("source_surface = 'certificate'") if "source_surface" in cert_assets.columns else cert_assets
    own = own.filter("serial IS NOT NULL")
    a = own.select("serial", F.col("asset_id").alias("from_id"), (F.col("purpose") == "hashing").alias("h1"))
    b = own.select("serial", F.col("asset_id").alias("to_id"), (F.col("purpose") == "hashing").alias("h2"))
    return a.join(b, "serial").filter("h1 <> h2").select("from_id", "to_id", F.when(F.col("h1"), "cert_uses_key").otherwise("cert_signed_with").alias("kind"), F.concat(F.lit("same certificate, serial "), "serial").alias("evidence"))


def cross_surface_edges(assets: DataFrame) -> DataFrame:
    """Edges between the first assets of a family on each two surfaces."""
    rep = assets.groupBy(family_of(F.col("algorithm")).alias("family"), "source_surface").agg(F.min(F.struct("file_path", F.coalesce("line_number", F.lit(0)).alias("line"), "first_seq", "seq")).alias("r"))
    a = rep.select("family", F.col("source_surface").alias("s1"), F.col("r.seq").alias("from_id"))
    b = rep.select("family", F.col("source_surface").alias("s2"), F.col("r.seq").alias("to_id"))
    same = F.concat(F.lit("family "), "family", F.lit(" on "), "s1", F.lit(" and "), "s2")
    return a.join(b, "family").filter("s1 < s2").select("from_id", "to_id", "family", F.lit("cross_surface").alias("kind"), same.alias("evidence"))


def invokes_edges(assets: DataFrame, most: int = EDGES) -> DataFrame:
    """Edges from source code to assets that observe a sibling symbol of it; `most` per source in order of file, line, ingestion.

    The sibling isn't the source's own symbol and stands in its snippet. Holders are ranked per symbol and cut to
    most + 1 before the join: a source needs no more, and no symbol fans out.
    """
    order = ["file_path", F.coalesce("line_number", F.lit(0)), "first_seq"]
    held = assets.filter("observed_symbol IS NOT NULL").select("seq", "observed_symbol", F.row_number().over(Window.partitionBy("observed_symbol").orderBy(*order)).alias("r")).filter(F.col("r") <= most + 1)
    src = assets.filter("source_surface = 'source_code'").select("seq", "observed_symbol", "snippet", F.posexplode("sibling_symbols").alias("g", "symbol"))
    src = src.filter((F.col("observed_symbol").isNull() | (F.col("symbol") != F.col("observed_symbol"))) & F.contains(F.coalesce("snippet", F.lit("")), F.col("symbol")))
    edges = src.join(held.select(F.col("seq").alias("to_id"), F.col("observed_symbol").alias("symbol"), "r"), "symbol").filter("seq <> to_id")
    w = Window.partitionBy("seq").orderBy("g", "r")
    edges = edges.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)
    return edges.select(F.col("seq").alias("from_id"), "to_id", F.lit("source_invokes").alias("kind"), F.concat(F.lit("sibling symbol '"), "symbol", F.lit("' in same statement")).alias("evidence"), "k")


def linked(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """Edges of all kinds together: none to itself, each pair once, `most` per source in order of kind, then of the edge; evidence is cut."""
    kind = F.lit(len(EDGE_KINDS))
    for i, k in reversed(list(enumerate(EDGE_KINDS))):
        kind = F.when(F.col("kind") == k, i).otherwise(kind)
    x = edges.filter("from_id <> to_id").withColumn("_o", kind)
    x = x.groupBy("from_id", "to_id").agg(F.min(F.struct("_o", "_k", "kind", F.left("evidence", F.lit(EVIDENCE)).alias("evidence"))).alias("e")).select("from_id", "to_id", "e.*")
    w = Window.partitionBy("from_id").orderBy("_o", "_k", "to_id")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("from_id", "to_id", "kind", "evidence", "rank")


def dependencies(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """(from_id, depends_on) distinct targets, in order, of edges whose both ends exist; at most EDGES a source where the edges come from linked()."""
    ids = assets.select(F.col("seq").alias("id"))
    both = edges.join(ids, F.col("from_id") == F.col("id"), "left_semi").join(ids, F.col("to_id") == F.col("id"), "left_semi")
    return both.select("from_id", "to_id").distinct().groupBy("from_id").agg(F.array_sort(F.collect_list("to_id")).alias("depends_on"))


def properties(assets: DataFrame) -> Column:
    """Namespaced properties of an asset; null and empty values, and those whose column is absent, are left out."""
    there = set(assets.columns)
    flag = lambda c: F.initcap(F.col(c).cast("string"))
    number = lambda digits: lambda c: F.when(F.col(c).isNotNull(), fixed(F.col(c), digits))
    cut = lambda c: F.left(c, F.lit(500))
    place = F.coalesce(F.col("location"), F.lit("")) if "location" in there else F.concat_ws(":", "file_path", F.col("line_number").cast("string"))
    told = [("location", place)]
    for name, column, form in (
        ("purpose", "purpose", F.col), ("classification", "classification", F.col), ("sensitivity", "sensitivity", F.col), ("business_criticality", "criticality", F.col), ("lifecycle_stage", "lifecycle_stage", F.col),
        ("source_surface", "source_surface", F.col), ("owner", "owner", F.col), ("protocol", "protocol", F.col), ("library", "library", F.col), ("scan_id", "scan_id", F.col),
        ("evidence.rule_id", "rule_id", F.col), ("evidence.method", "detection_method", F.col), ("evidence.confidence", "confidence", number(4)), ("evidence.symbol", "observed_symbol", F.col), ("evidence.ambiguity", "ambiguity_status", F.col),
        ("risk.priority", "priority", F.col), ("risk.urgency", "urgency_flag", flag), ("risk.hndl", "hndl_flag", flag), ("risk.mosca_x", "x_years", number(1)), ("risk.mosca_y", "y_years", number(1)), ("risk.mosca_z", "z_years", number(1)),
        ("recommendation.replacement", "rec_replacement", F.col), ("recommendation.migration_path", "rec_path", F.col), ("recommendation.status", "rec_status", F.col),
        ("reachability.reachable", "reachable", flag), ("reachability.context", "exposure_context", cut),
        ("migration.priority", "migration_priority", F.col), ("migration.impact_level", "impact_level", F.col), ("migration.score", "composite", number(3)), ("migration.narrative", "narrative", cut),
    ):
        if column in there:
            told.append((name, form(column)))
    pairs = F.array(*[F.struct(F.lit(f"inventory:{k}").alias("name"), v.cast("string").alias("value")) for k, v in told])
    return F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != ""))


def components(assets: DataFrame) -> DataFrame:
    """Bill-of-materials components: algorithms with their primitive, certificates with their subject's common name."""
    primitive = F.lit("unknown")
    for p, v in R.PRIMITIVES:
        primitive = F.when(F.col("purpose") == p, v).otherwise(primitive)
    there = lambda c: F.col(c).cast("string") if c in assets.columns else F.lit(None).cast("string")
    certificate = F.col("source_surface") == "certificate"
    subject = there("certificate_subject")
    name = F.when(certificate, F.coalesce(common_name(subject), F.nullif(subject, F.lit("")), F.col("algorithm"))).otherwise(F.col("algorithm"))
    purpose = F.replace("purpose", F.lit("_"), F.lit(" "))
    described = F.when(certificate, F.concat(F.lit("X.509 certificate — "), "algorithm", F.lit(" ("), purpose, F.lit(")"))).otherwise(F.concat(F.col("algorithm"), F.lit(" ("), purpose, F.lit(") — "), there("classification"), F.lit(" cryptography")))
    dates = F.when(certificate, F.struct(subject.alias("subjectName"), there("certificate_issuer").alias("issuerName"), there("certificate_expiry").alias("notValidAfter"), F.lit("X.509").alias("certificateFormat")))
    body = F.struct(
        F.lit("cryptographic-asset").alias("type"),
        F.col("seq").cast("string").alias("bomRef"),
        name.alias("name"),
        described.alias("description"),
        F.when(certificate, "certificate").otherwise("algorithm").alias("assetType"),
        F.when(~certificate, primitive).alias("primitive"),
        dates.alias("certificate"),
        properties(assets).alias("properties"),
    )
    return assets.select("seq", body.alias("component"))


def common_name(subject: Column) -> Column:
    return F.nullif(F.regexp_extract(subject, r"(?:^|,)\s*CN=([^,]*)", 1), F.lit(""))


def document(parts: DataFrame, depends: DataFrame, scan: str, timestamp: str) -> DataFrame:
    """A bill of materials in JSON as ordered lines (section, ord, line): head, components, dependencies, tail.

    Written in order the lines are one document, which so never passes through one row or one task.
    """
    head = parts.sparkSession.createDataFrame([(0, 0, '{"bomFormat":"CycloneDX","specVersion":"1.6","metadata":{"scan":' + json.dumps(scan) + ',"timestamp":' + json.dumps(timestamp) + '},"components":['), (2, 0, '],"dependencies":['), (4, 0, "]}")], "section int, ord long, line string")
    comma = lambda first: F.when(~first, F.lit(",")).otherwise(F.lit(""))
    least = lambda df, key: F.broadcast(df.agg(F.min(key).alias("_least")))
    c = parts.crossJoin(least(parts, "seq")).select(F.lit(1).alias("section"), F.col("seq").cast("long").alias("ord"), F.concat(comma(F.col("seq") == F.col("_least")), F.to_json("component")).alias("line"))
    refs = F.struct(F.col("from_id").cast("string").alias("ref"), F.transform("depends_on", lambda x: x.cast("string")).alias("dependsOn"))
    p = depends.crossJoin(least(depends, "from_id")).select(F.lit(3).alias("section"), F.col("from_id").cast("long").alias("ord"), F.concat(comma(F.col("from_id") == F.col("_least")), F.to_json(refs)).alias("line"))
    return head.unionByName(c).unionByName(p)


#: Characters that XML 1.0 doesn't allow, for Spark's expressions and for Python's.
_NOT_XML = "[^\\x09\\x0A\\x0D\\x20-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]"
_XML_BAD = "[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]"


def printable(assets: DataFrame) -> DataFrame:
    """Assets whose text columns hold U+FFFD in place of characters that XML doesn't allow."""
    texts = {f.name: F.regexp_replace(F.col(f"`{f.name}`"), _NOT_XML, "\ufffd") for f in assets.schema.fields if f.dataType.simpleString() == "string"}
    return assets.withColumns(texts) if texts else assets


def document_xml(parts: DataFrame, depends: DataFrame, scan: str, timestamp: str) -> DataFrame:
    """A bill of materials in XML as ordered lines (section, ord, line), with what document() tells in JSON.

    A component is an element with its fields as elements, a property each in an element of its own; a row holds one
    component, so no document passes through one row or one task. Components must be of printable() assets.
    """
    named = lambda k, v: f"<{k}>{escape(re.sub(_XML_BAD, chr(0xFFFD), v))}</{k}>"
    top = '<?xml version="1.0" encoding="UTF-8"?><bom><bomFormat>CycloneDX</bomFormat><specVersion>1.6</specVersion><metadata>' + named("scan", scan) + named("timestamp", timestamp) + "</metadata><components>"
    head = parts.sparkSession.createDataFrame([(0, 0, top), (2, 0, "</components><dependencies>"), (4, 0, "</dependencies></bom>")], "section int, ord long, line string")
    c = parts.select(F.lit(1).alias("section"), F.col("seq").cast("long").alias("ord"), F.to_xml("component", {"rowTag": "component"}).alias("line"))
    refs = F.struct(F.col("from_id").cast("string").alias("ref"), F.transform("depends_on", lambda x: x.cast("string")).alias("dependsOn"))
    p = depends.select(F.lit(3).alias("section"), F.col("from_id").cast("long").alias("ord"), F.to_xml(refs, {"rowTag": "dependency"}).alias("line"))
    return head.unionByName(c).unionByName(p)


def reexport(stored: DataFrame, scan: str, timestamp: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """(lines, bill) of one scan from the table that sources.tables.write_assets() keeps: the document anew, and a row (scan_id, format, component_count, coverage rates).

    Only the scan's own partition is read. Targets of relationships come from `depends_on` where assets carry it, and
    only those that the scan still has. A scan without assets gives an empty document and a count of 0.
    """
    own = stored.filter(F.col("scan_id") == scan).drop("asset_json")
    own = own if fmt == "json" else printable(own)
    parts = components(own)
    if "depends_on" in own.columns:
        edges = own.select(F.col("seq").alias("from_id"), F.explode("depends_on").alias("to_id"))
        depends = dependencies(edges, own)
    else:
        depends = stored.sparkSession.createDataFrame([], "from_id long, depends_on array<long>")
    lines = (document if fmt == "json" else document_xml)(parts, depends, scan, timestamp)
    rated = quality(own) if {"rule_id", "priority", "rec_replacement", "n_observed"} <= set(own.columns) else None
    bill = own.agg(F.lit(scan).alias("scan_id"), F.lit(fmt).alias("format"), F.count("*").alias("component_count"))
    return lines, bill if rated is None else bill.crossJoin(F.broadcast(rated))


def quality(assets: DataFrame, observed: int | None = None) -> DataFrame:
    """One row of coverage rates to 4 places; all 0 for an empty table. Columns: rule_id, priority, rec_replacement, n_observed."""
    has = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    complete = F.col("algorithm").isNotNull() & F.col("purpose").isNotNull() & (F.col("purpose") != "unknown") & F.col("file_path").isNotNull()
    q = assets.agg(has(F.col("rule_id").isNotNull()).alias("e"), has(complete).alias("c"), has(F.col("priority").isNotNull()).alias("r"), has(F.col("rec_replacement").isNotNull()).alias("m"), (1 - F.count("*") / F.sum("n_observed")).alias("d"))
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return q.select(z(F.col("e")).alias("evidence"), z(F.col("c")).alias("completeness"), z(F.col("r")).alias("risk"), z(F.col("m")).alias("recommendation"), z(F.col("d")).alias("duplicate_rate"), z(0.30 * F.col("e") + 0.20 * F.col("c") + 0.25 * F.col("r") + 0.25 * F.col("m")).alias("overall"))


def version_diff(old: DataFrame, new: DataFrame, columns: tuple[str, ...] = ("algorithm", "purpose", "priority", "rec_replacement")) -> DataFrame:
    """(asset_id, change) of assets that are new, removed or changed in any of the columns, in order of change and id."""
    o = old.select("asset_id", F.struct(*columns).alias("o"))
    n = new.select("asset_id", F.struct(*columns).alias("n"))
    kind = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return o.join(n, "asset_id", "full_outer").select("asset_id", kind.alias("change")).filter("change IS NOT NULL").orderBy("change", "asset_id")


SORTABLE = ("algorithm", "purpose", "priority", "classification", "source_surface", "file_path", "seq")


def matching(assets: DataFrame, *, algorithm: str | None = None, purpose: str | None = None, classification: str | None = None, priority: str | None = None, surface: str | None = None) -> DataFrame:
    """Assets whose algorithm contains a text in any case and whose other columns equal what is given."""
    x = assets
    if algorithm:
        x = x.filter(F.lower("algorithm").contains(algorithm.lower()))
    for col, v in (("purpose", purpose), ("classification", classification), ("priority", priority), ("source_surface", surface)):
        if v:
            x = x.filter(F.col(col) == v)
    return x


def page_order(sort: str = "seq") -> tuple[Column, ...]:
    """Columns that a page is sorted by, the id last: `location` is file and line, an unknown name the id alone."""
    if sort == "location":
        return F.col("file_path"), F.col("line_number"), F.col("seq")
    return (F.col(sort), F.col("seq")) if sort in SORTABLE and sort != "seq" else (F.col("seq"),)


def risk_order() -> tuple[Column, ...]:
    """Order of risk_page()."""
    return F.coalesce("priority", F.lit("P5")), F.col("file_path"), F.col("line_number"), F.col("seq")


def page(assets: DataFrame, *, sort: str = "seq", limit: int = 50, offset: int = 0, **filters: str | None) -> tuple[DataFrame, DataFrame]:
    """A page and the total over the same filters, those of matching(). limit 1 to 500, offset from 0; unknown sort columns fall back to the id.

    Each task keeps its first offset + limit rows; for deep pages write the rows in ranges once (pages.write_ranges with
    page_order) and read the ranges that hold them.
    """
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset 0 or more")
    x = matching(assets, **filters)
    return x.orderBy(*page_order(sort)).offset(offset).limit(limit), x.agg(F.count("*").alias("total"))


def certificate_page(assets: DataFrame, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of the certificate surface by place, and the total of that surface."""
    return page(assets, surface="certificate", sort="location", limit=limit, offset=offset)


def dashboard(assets: DataFrame, coverage: DataFrame | None = None) -> DataFrame:
    """One row of totals by priority and class; with `coverage`, the one row of completeness(), its overall percentage too."""
    out = assets.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("priority").isNotNull() & (F.col("priority") != "P4")).alias("quantum_vulnerable"),
        F.count_if(F.col("priority") == "P1").alias("p1"),
        F.count_if("hndl_flag").alias("hndl"),
        *[F.count_if(F.col("priority") == p).alias(f"n_{p.lower()}") for p in ("P2", "P3", "P4")],
        *[F.count_if(F.col("classification") == c).alias(f"n_{c}") for c in ("application", "infrastructure")],
    )
    return out if coverage is None else out.crossJoin(F.broadcast(coverage.select(F.col("overall_pct").alias("coverage_pct"))))


def top_findings(assets: DataFrame, n: int = 10) -> DataFrame:
    """The first n findings of the highest priority by place; n is 1 to 100."""
    if not 1 <= n <= 100:
        raise ValueError("n must be 1 to 100")
    return assets.filter("priority = 'P1'").orderBy("file_path", "line_number", "seq").limit(n)


def scan_summary(assets: DataFrame) -> DataFrame:
    """A row for each scan: assets, certificates, harvest exposure, and maps of counts by surface and by priority."""
    total = assets.groupBy("scan_id").agg(
        F.count("*").alias("asset_count"),
        F.count_if(F.col("source_surface") == "certificate").alias("certificate_asset_count"),
        F.count_if("hndl_flag").alias("hndl_count"),
        *[F.count_if(F.col("source_surface") == s).alias(f"_s{i}") for i, s in enumerate(R.SURFACES)],
        *[F.count_if(F.col("priority") == p).alias(f"_p{i}") for i, p in enumerate(R.PRIORITIES)],
    )
    pairs = lambda names, k: F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.col(f"_{k}{i}"))])
    return total.select("scan_id", "asset_count", "certificate_asset_count", "hndl_count", pairs(R.SURFACES, "s").alias("surface_counts"), pairs(R.PRIORITIES, "p").alias("priority_counts"))


def risk_page(assets: DataFrame, limit: int = 50, offset: int = 0, priority: str | None = None) -> DataFrame:
    """A page of assets by priority, then by place; unscored ones come last."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset 0 or more")
    x = assets if priority is None else assets.filter(F.col("priority") == priority)
    return x.orderBy(*risk_order()).offset(offset).limit(limit)


def reachability_page(assets: DataFrame, summary: DataFrame | None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page by place, and the summary; without one, a summary in which every verdict is unknown."""
    page_ = page(assets, sort="location", limit=limit, offset=offset)[0]
    zero = F.lit(0).cast("long")
    default = assets.agg(F.count("*").alias("total"), zero.alias("reachable"), zero.alias("unreachable"), F.count("*").alias("unknown"), F.lit(0.0).alias("rate"))
    return page_, default if summary is None else summary


def roadmaps(assets: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored roadmaps with their assets, by scan and asset."""
    return stored.join(assets, ["scan_id", "seq"])


def enrichment_status(assets: DataFrame) -> DataFrame:
    """A row for each scan: assets, ambiguous ones that may be sent, and those already enriched."""
    done = F.col("finding_type") == "llm_enriched"
    return assets.groupBy("scan_id").agg(F.count("*").alias("total"), F.count_if(~done & F.col("ambiguous")).alias("eligible"), F.count_if(done).alias("enriched"))


def bill_payload(scans: DataFrame, bills: DataFrame, assets: DataFrame) -> DataFrame:
    """(scan_id, ord, payload): a scan's stored bill as JSON rows, the head (ord 0) first and then an asset each, so no scan has to fit one row."""
    head = scans.join(bills, "scan_id").select("scan_id", F.lit(0).cast("long").alias("ord"), F.to_json(F.struct("scan_id", "status", "component_count", "format")).alias("payload"))
    rows = assets.join(bills.select("scan_id"), "scan_id", "left_semi").select("scan_id", (F.col("seq") + 1).alias("ord"), F.to_json(F.struct(*[c for c in assets.columns if c != "scan_id"])).alias("payload"))
    return head.unionByName(rows)


def scan_history(scans: DataFrame, user: str | None = None, limit: int = 50) -> DataFrame:
    x = scans if user is None else scans.filter((F.col("user_id") == user) | F.col("user_id").isNull())
    return x.orderBy(F.col("created_at").desc(), F.col("ord").desc()).limit(min(max(limit, 1), 200))


def latest_scan(scans: DataFrame) -> DataFrame:
    return scans.agg(F.max_by(F.struct("scan_id", "status"), F.struct("created_at", "ord")).alias("s")).select("s.*")


def sweep_stale(scans: DataFrame, as_of: str, minutes: int = 30) -> DataFrame:
    stale = F.col("status").isin("pending", "running") & (F.col("created_at").isNull() | (F.col("created_at") <= F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {minutes} MINUTES")))
    return scans.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def artifacts(scans: DataFrame) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("pipeline_report", "migration_report", "certificate_report", "cbom")])
    return scans.filter("status = 'complete'").select("scan_id", F.explode(kinds).alias("artifact"))


def backfill(stored: DataFrame, column: str) -> DataFrame:
    """Fills nulls of a column from the row's JSON; a second run changes nothing."""
    return stored.withColumn(column, F.coalesce(F.col(column), F.get_json_object("asset_json", f"$.{column}")))


def report_lines(assets: DataFrame, scan: str = "", status: str = "complete") -> DataFrame:
    """Ordered lines of the run's report: counts, then an asset a line by place."""
    d = dashboard(assets)
    rows = [("total assets", "total"), ("quantum vulnerable", "quantum_vulnerable"), ("P1", "p1"), ("P2", "n_p2"), ("P3", "n_p3"), ("P4", "n_p4"), ("HNDL", "hndl"), ("application", "n_application"), ("infrastructure", "n_infrastructure")]
    head = [F.lit(f"scan: {scan}"), F.lit(f"status: {status}")] if scan else []
    counts = [F.concat(F.lit(f"{k}: "), F.col(c).cast("string")) for k, c in rows]
    return d.select(F.posexplode(F.array(*head, *counts)).alias("line_no", "line"))


def asset_lines(assets: DataFrame) -> DataFrame:
    """(file_path, line_number, seq, line): a line for each asset, to be written in that order."""
    return assets.select("file_path", "line_number", "seq", F.concat(F.lit("  "), F.concat_ws(":", "file_path", F.col("line_number").cast("string")), F.lit(" "), "algorithm").alias("line"))


def _block(rows: DataFrame, lines: Column) -> DataFrame:
    return rows.select("_order", F.posexplode(lines).alias("line_no", "line")).filter("line IS NOT NULL").select("_order.*", "line_no", "line")


def migration_report(migrated: DataFrame) -> DataFrame:
    """(rank, file_path, at, seq, line_no, line): a block of lines for each roadmap, by priority and then place."""
    place = F.concat_ws(":", "file_path", F.col("line_number").cast("string"))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in R.PRIORITIES]), F.col("priority")), F.lit(4).cast("long"))
    told = lambda k, v: F.concat(F.lit(f"  {k:<9}: "), v)
    lines = F.concat(
        F.array(
            F.concat("algorithm", F.lit(" ["), F.coalesce("priority", F.lit("Unscored")), F.lit("]")),
            told("Location", place), told("Current", F.col("current_state")), told("Risk", F.col("risk_context")), told("Action", F.col("action")), told("Priority", F.col("migration_priority")),
            told("Impact", F.concat(fixed(F.col("composite"), 4), F.lit(" ("), "impact_level", F.lit(")"))),
            told("Affected", F.array_join("components", ", ")),
            F.lit("  Validate :"),
        ),
        F.transform("steps", lambda x: F.concat(F.lit("    - "), x)),
        F.array(F.lit("")),
    )
    return _block(migrated.withColumn("_order", F.struct(rank.alias("rank"), "file_path", F.coalesce("line_number", F.lit(0)).alias("at"), "seq")), lines)


def certificate_report(certs: DataFrame) -> DataFrame:
    """(file_path, seq, line_no, line): a block of lines for each asset of the certificate surface, by place."""
    told = lambda k, v: F.concat(F.lit(f"  {k:<9}: "), F.coalesce(v.cast("string"), F.lit("None")))
    lines = F.array(
        F.concat("algorithm", F.lit(" ["), F.coalesce("priority", F.lit("Unscored")), F.lit("]")),
        told("Location", F.col("file_path")), told("Subject", F.col("certificate_subject")), told("Issuer", F.col("certificate_issuer")), told("Expiry", F.col("certificate_expiry")),
        told("Lifecycle", F.col("lifecycle_stage")), told("Owner", F.coalesce(F.nullif("owner", F.lit("")), F.lit("unassigned"))),
        F.lit(""),
    )
    return _block(certs.withColumn("_order", F.struct("file_path", "seq")), lines)

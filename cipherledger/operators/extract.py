"""Findings from code lines, strings, manifests, handshakes and certificates; evidence shaping; enrichment."""

from __future__ import annotations

import re
from collections.abc import Callable
from re import _parser as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import rules as R

def canonical(base: Column, size: Column, curve_name: Column) -> Column:
    return F.when(curve_name.isNotNull(), F.concat(base, F.lit("-"), curve_name)).when(size.isNotNull(), F.concat(base, F.lit("-"), size.cast("string"))).otherwise(base)


def confidence(base: Column, has_size: Column, parse_error: Column) -> Column:
    c = F.least(F.lit(1.0), base + F.when(has_size, 0.01).otherwise(0.0)) - F.when(parse_error, 0.05).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 4)


def coerce_purpose(purpose: Column) -> Column:
    return F.when(F.lower(purpose).isin(*R.PURPOSES), F.lower(purpose)).otherwise("unknown")


def violations(findings: DataFrame) -> DataFrame:
    """(seq, problem) of rows that break a record rule; good rows give nothing."""
    there = lambda c: F.col(c) if c in findings.columns else F.lit(None)
    enriched = F.coalesce(there("finding_type") == "llm_enriched", F.lit(False))
    more = [
        (there("end_line_number") < F.col("line_number"), "end before line"),
        (enriched & there("llm_prompt_version").isNull(), "enriched without prompt version"),
        (there("urgency_flag").isNotNull() & ~there("urgency_flag").cast("boolean").eqNullSafe(there("x_years") + there("y_years") > there("z_years")), "urgency flag differs"),
        (F.lit("rule_id" in findings.columns) & there("rule_id").isNull(), "no evidence"),
    ]
    checks = [(F.coalesce(F.length(F.trim("algorithm")), F.lit(0)) == 0, "empty algorithm"), (F.coalesce(F.length("file_path"), F.lit(0)) == 0, "empty location"), (~F.col("confidence").between(0, 1), "confidence out of range"), (F.col("line_number") < 1, "line below 1"), (~F.col("source_surface").isin(*R.SURFACES), "unknown surface")]
    return findings.select("seq", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in checks + more]))).alias("problem"))


def ascii_runs(blobs: DataFrame, content: str = "content", most: int = 20_000) -> DataFrame:
    """(file_path, pos, s): printable runs of six characters and more, the first 20,000 of a blob, which is the operator's own limit."""
    runs = F.slice(F.regexp_extract_all(F.decode(F.col(content), "ISO-8859-1"), F.lit("([ -~]{6,})"), F.lit(1)), 1, most)
    return blobs.select("file_path", F.posexplode(runs).alias("pos", "s"))


#: Patterns up to which each is compiled into the expression; more are found by a literal that they need.
MAX_COMPILED = 64
#: Letters of such a literal that are joined by.
GRAM = 3


def needed_literal(pattern: str) -> str:
    """The longest text, in lower case, that every match of a regular expression holds, as far as it is written out; '' without one."""
    try:
        parsed = sre.parse(pattern)
    except re.error:  # written for Java alone
        return ""
    runs = [""]
    for op, arg in parsed:
        if op is sre.LITERAL:
            runs[-1] += chr(arg).lower()
        else:
            runs.append("")
    return max(runs, key=len)


def with_rules(rows: DataFrame, text: str, rules: tuple | DataFrame) -> DataFrame:
    """rows joined with (rule_id, pattern, algorithm, purpose, confidence) of the rules whose pattern the text holds, case ignored.

    rules: rows (rule_id, pattern, algorithm, purpose, confidence) or a table of load_patterns(), which is edited by hand
    and comes to the driver. A few are compiled into one expression. Of many, those with a literal of GRAM letters meet
    the texts by its first letters, an equi-join, and only those pairs are tested; the rest are compiled.
    """
    spark, names = rows.sparkSession, ("rule_id", "pattern", "algorithm", "purpose", "confidence")
    table = [tuple(r[c] for c in names) for r in rules.orderBy("ord").collect()] if isinstance(rules, DataFrame) else [tuple(r) for r in rules]
    grams = [needed_literal(r[1])[:GRAM] if len(table) > MAX_COMPILED else "" for r in table]
    plain = [r for r, g in zip(table, grams, strict=True) if len(g) < GRAM]
    hits = [F.when(F.col(text).rlike(f"(?i){r[1]}"), F.struct(*[F.lit(v).alias(c) for c, v in zip(names, r, strict=True)])) for r in plain]
    columns = [F.col(f"`{c}`") for c in rows.columns]
    kind = "array<struct<rule_id:string,pattern:string,algorithm:string,purpose:string,confidence:double>>"
    out = rows.select(*columns, F.inline(F.array_compact(F.array(*hits)).cast(kind))) if hits else None
    if len(plain) == len(table) and out is not None:
        return out
    known = spark.createDataFrame([(*r, g) for r, g in zip(table, grams, strict=True) if len(g) == GRAM], "rule_id string, pattern string, algorithm string, purpose string, confidence double, _gram string")
    low = F.lower(text)
    cut = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - GRAM + 1), lambda i: F.substring(low, i, F.lit(GRAM))))
    many = rows.filter(F.length(low) >= GRAM).select(*columns, F.explode(cut).alias("_gram")).join(known, "_gram").filter(F.expr(f"`{text}` rlike concat('(?i)', pattern)")).drop("_gram")
    return many if out is None else out.unionByName(many)


def match_strings(strings: DataFrame, rules: tuple | DataFrame = R.FINGERPRINTS) -> DataFrame:
    """First matching string per file and rule; patterns ignore case."""
    hit = with_rules(strings, "s", rules)
    return hit.groupBy("file_path", "rule_id").agg(F.min_by("s", "pos").alias("observed"), F.first("algorithm").alias("algorithm"), F.first("purpose").alias("purpose"), F.first("confidence").alias("confidence"))


def match_manifests(lines: DataFrame, most: int = 50, rules: tuple | DataFrame = R.CONTAINER) -> DataFrame:
    """First matching line per image, manifest and rule, over known manifest names; the first 50 manifests of an image, the operator's own limit."""
    from pyspark.sql import Window

    x = lines.filter(F.lower("manifest").isin(*R.MANIFESTS))
    keep = x.select("image_ref", "manifest").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("image_ref").orderBy("manifest"))).filter(F.col("_r") <= most).drop("_r")
    hit = with_rules(x.join(keep, ["image_ref", "manifest"]), "line", rules)
    first = hit.groupBy("image_ref", "manifest", "rule_id").agg(F.min(F.struct("line_no", "line")).alias("m"), F.first("algorithm").alias("algorithm"))
    return first.select(F.concat("image_ref", F.lit(" :: "), "manifest").alias("location"), "rule_id", F.col("m.line_no").alias("line_no"), "algorithm")


def match_ciphers(handshakes: DataFrame, rules: tuple | DataFrame = R.INFRA) -> DataFrame:
    """Algorithm of a handshake's suite by the first rule in order; others give no asset. Compiled to one expression."""
    rule, alg, purpose = (F.lit(None).cast("string"),) * 3
    rows = [tuple(r[c] for c in ("rule_id", "pattern", "algorithm", "purpose", "confidence")) for r in rules.orderBy("ord").collect()] if isinstance(rules, DataFrame) else rules
    for r, pattern, a, p, _ in reversed(rows):
        hit = F.col("cipher_suite").rlike(f"(?i){pattern}")
        rule, alg, purpose = F.when(hit, r).otherwise(rule), F.when(hit, a).otherwise(alg), F.when(hit, p).otherwise(purpose)
    return handshakes.select("event_id", "endpoint", rule.alias("rule_id"), alg.alias("algorithm"), purpose.alias("purpose")).filter("rule_id IS NOT NULL")


def parse_endpoint(ref: Column) -> Column:
    """struct<host, port> of host[:port], port 443 where absent; null for a scheme, white space, several colons or a port out of range."""
    port = F.when(ref.contains(":"), F.split_part(ref, F.lit(":"), F.lit(2)).try_cast("int")).otherwise(443)
    ok = ~ref.contains("://") & ~ref.rlike(r"\s") & (F.regexp_count(ref, F.lit(":")) <= 1) & port.between(1, 65535)
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(F.split_part(ref, F.lit(":"), F.lit(1)).alias("host"), port.alias("port")))


def parse_image(ref: Column) -> Column:
    """struct<registry, name, tag, digest> of an image reference."""
    part = lambda k: F.nullif(F.regexp_extract(ref, R.IMAGE_REF, k), F.lit(""))
    return F.struct(part(1).alias("registry"), part(2).alias("name"), part(3).alias("tag"), part(4).alias("digest"))


def image_refs(refs: DataFrame) -> DataFrame:
    """(image_ref, registry, name, tag, digest, status): invalid references are error rows, valid ones are recorded."""
    x = parse_image(F.col("image_ref"))
    ok = x["name"].isNotNull()
    part = lambda k: F.when(ok, x[k]).alias(k)
    return refs.select("image_ref", part("registry"), part("name"), part("tag"), part("digest"), F.when(ok, "recorded").otherwise("error").alias("status"))


def public_key(kind: Column, size: Column, curve: Column) -> tuple[Column, Column]:
    """Canonical algorithm and purpose of a public key; null for a kind that isn't known. A curve without a name of its own is spelled in capitals."""
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in R.CURVE_NAMES for x in kv]), curve), F.concat(F.lit("ECDSA-"), F.upper(curve)))
    sized = F.concat(kind, F.lit("-"), size.cast("string"))
    algorithm = F.when(kind.isin("RSA", "DSA"), sized).when(kind == "EC", named).when(kind.isin(*R.PLAIN_KEYS), kind)
    return algorithm, F.when(kind.isin("RSA", "X25519", "X448"), "key_establishment").otherwise("digital_signature")


def hash_name(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in R.HASH_NAMES for x in kv]), F.lower(name))


def certificate_assets(certs: DataFrame) -> DataFrame:
    """Up to two assets of a certificate: its key (C-001) and its signature hash (C-002), both at 0.99; unknown kinds give none."""
    alg, use = public_key(F.col("pk_type"), F.col("key_size"), F.col("curve"))
    item = lambda r, a, p: F.when(a.isNotNull(), F.struct(F.lit(r).alias("rule_id"), a.alias("algorithm"), p.alias("purpose"), F.lit(0.99).alias("confidence")))
    both = F.array_compact(F.array(item("C-001", alg, use), item("C-002", hash_name(F.col("sig_hash")), F.lit("hashing"))))
    x = certs.select("cert_id", "file_path", "serial", "days_to_expiry", "subject", F.explode(both).alias("x")).select("cert_id", "file_path", "serial", "days_to_expiry", "subject", "x.*")
    return x.withColumn("common_name", display_name(F.col("subject"), F.col("algorithm")))


def display_name(subject: Column, algorithm: Column) -> Column:
    """Common name of a subject, else the whole subject, else the algorithm."""
    return F.coalesce(F.nullif(F.regexp_extract(subject, r"(?:^|,)\s*CN=([^,]*)", 1), F.lit("")), F.nullif(subject, F.lit("")), algorithm)


def peer_assets(handshakes: DataFrame) -> DataFrame:
    """Assets of the certificates that peers show: the key (I-100, 0.97) and a weak signature hash (I-101, 0.95).

    They are infrastructure, critical and reachable from the start; a failed handshake or a kind that isn't known gives none.
    """
    alg, use = public_key(F.col("pk_type"), F.col("key_size"), F.col("curve"))
    weak = F.when(F.lower("sig_hash").isin("md5", "sha1"), hash_name(F.col("sig_hash")))
    item = lambda r, a, p, c, level: F.when(a.isNotNull(), F.struct(F.lit(r).alias("rule_id"), a.alias("algorithm"), p.alias("purpose"), F.lit(c).alias("confidence"), F.lit(level).alias("sensitivity")))
    both = F.array_compact(F.array(item("I-100", alg, use, 0.97, "critical"), item("I-101", weak, F.lit("hashing"), 0.95, "high")))
    x = handshakes.filter("NOT failed").select("event_id", "endpoint", F.explode(both).alias("x")).select("event_id", F.concat(F.lit("tls://"), "endpoint").alias("location"), "x.*")
    return x.withColumns({"source_surface": F.lit("infrastructure"), "classification": F.lit("infrastructure"), "criticality": F.lit("critical"), "reachable": F.lit(True)})


def probe_counts(handshakes: DataFrame) -> DataFrame:
    """One row: endpoints asked, and those that failed or whose reference isn't valid; neither is ever a finding."""
    bad = F.coalesce(F.col("failed"), F.lit(False)) | parse_endpoint(F.col("endpoint")).isNull()
    return handshakes.agg(F.count("*").alias("endpoints_probed"), F.count_if(bad).alias("endpoints_failed"))


def _replaced(text: Column, steps: list[tuple[str, str]], mark: str) -> Column:
    """struct(t, n): text with each pattern replaced in order, and the names of those that changed it. Each step reads the one before it once, as a bound variable; written out, the steps would double at each."""

    def step(state: Column, name: str, pattern: str) -> Column:
        new = _bound(state, lambda s: F.struct(s.alias("s"), F.regexp_replace(s["t"], pattern, mark).alias("t")))
        named = lambda x: F.when(x["t"] != x["s"]["t"], F.array_append(x["s"]["n"], F.lit(name))).otherwise(x["s"]["n"])
        return _bound(new, lambda x: F.struct(x["t"].alias("t"), named(x).alias("n")))

    state = F.struct(text.alias("t"), F.array().cast("array<string>").alias("n"))
    for name, pattern in steps:
        state = step(state, name, pattern)
    return state


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scrubbed(text: Column) -> Column:
    """struct(t, n): text with secrets replaced, and the names of those found. Put it in a column of its own before its fields are read, so it runs once."""
    return _replaced(text, [("aws_key", r"AKIA[0-9A-Z]{16}"), ("jwt", r"eyJ[\w-]+\.[\w-]+\.[\w-]+"), ("private_key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"), ("hex_secret", r"\b[0-9a-fA-F]{64}\b")], "[REDACTED]")


def stripped(text: Column) -> Column:
    """struct(t, n): text without control characters and with prompt injections replaced, and the names of those found."""
    clean = F.regexp_replace(text, r"[\p{Cc}\p{Cf}\p{Cs}&&[^\t\n\r]]", "")
    return _replaced(clean, [(n, p.replace("(?m)", "(?im)") if p.startswith("(?m)") else f"(?i){p}") for n, p in R.INJECTIONS], "[STRIPPED]")


def scrub(text: Column) -> tuple[Column, Column]:
    """Text with secrets replaced, and the names of those found."""
    out = scrubbed(text)
    return out["t"], out["n"]


def strip_injections(text: Column) -> tuple[Column, Column]:
    """Text without control characters and with prompt injections replaced, and the names of those found."""
    out = stripped(text)
    return out["t"], out["n"]


def truncate(text: Column, most: int = 2048) -> tuple[Column, Column]:
    """The text's first characters with a marker line behind them where it is longer, and whether it was."""
    long = F.coalesce(F.length(text) > most, F.lit(False))
    return F.when(long, F.concat(F.left(text, F.lit(most)), F.lit("\n[TRUNCATED]"))).otherwise(text), long


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character, to 4 places; 0 for empty text.

    Characters are sorted once; run lengths are the differences of the places where a new character starts.
    """
    n = F.length(text)
    chars = F.array_sort(F.split(text, ""))
    edges = lambda c: F.concat(F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: (i == 0) | (F.get(c, i) != F.get(c, i - 1))), F.array(F.size(c)))
    runs = lambda e: F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda a, i: (F.get(e, i + 1) - a) / F.element_at(e, F.lit(-1)))
    shares = F.flatten(F.transform(F.array(chars), lambda c: F.flatten(F.transform(F.array(edges(c)), runs))))
    total = F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.round(F.when(n > 0, total).otherwise(0.0), 4)


def cache_key(snippet: Column, version: str = "v1") -> Column:
    return F.concat(F.lit("llm:"), F.sha2(F.concat_ws("|", snippet, F.lit(version)), 256))


def validate_response(raw: Column) -> Column:
    """First reason to reject a responder's output, or null if it is sound. A confidence must be a JSON number."""
    keys = F.json_object_keys(raw)
    field = lambda k: F.get_json_object(raw, f"$.{k}")
    listed = lambda names: F.array(*[F.lit(k) for k in names])
    conf = field("confidence").try_cast("double")
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(raw), "$.confidence", "variant"))
    texts = lambda k: F.coalesce(F.schema_of_variant(F.variant_get(F.try_parse_json(raw), f"$.{k}", "variant")), F.lit("VOID")).isin("STRING", "VOID")
    return (
        F.when(F.octet_length(raw) > R.RESPONSE_BYTES, "too long")
        .when(F.try_parse_json(raw).isNull() | keys.isNull(), "not a JSON object")
        .when(F.arrays_overlap(keys, listed(R.PROHIBITED)), "prohibited field")
        .when(F.size(F.array_except(keys, listed(R.RESPONSE_FIELDS))) > 0, "unknown field")
        .when(~F.coalesce(field("purpose").isin(*R.PURPOSES), F.lit(False)), "unknown purpose")
        .when(F.coalesce(kind, F.lit("VOID")).isin("STRING", "BOOLEAN", "VOID") | conf.isNull() | ~conf.between(0, 1), "confidence out of range")
        .when(~texts("algorithm_hint") | (F.length(field("algorithm_hint")) > R.HINT_CHARS), "bad hint")
        .when(~texts("context_notes") | (F.length(field("context_notes")) > R.NOTES_CHARS), "bad notes")
    )

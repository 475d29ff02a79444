"""Queries over code lines, certificates' peers, enrichment and the call graph of code, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import detect as T
from ..operators import enrich as E
from ..operators import extract as X
from ..operators import lexer as L
from ..operators import reach as G
from ..sources.rule_files import detection_problems, load_detection_rules
from ..sources.tables import language_of
from . import detection as D
from . import rules as R
from .fixtures import ctes, load
from .queries import AS_OF, _s, _with, query

_LANGUAGE = "CASE lower(regexp_extract(file_path, '(\\.[A-Za-z]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in R.LANGUAGES) + " END"
# Lexing in SQL: what each line's tokens leave open by the state that it begins in, then the states line after line by
# recursion; the same for the bracket depth. States are those of operators/lexer.py.
_CLOSES = (r"^(?:\\.|[^\\])*?\"\"\"", r"^(?:\\.|[^\\])*?'{3}", r'^(?:\\.|[^"\\])*"', r"^(?:\\.|[^'\\])*'", r"^.*?\*/", r"^(?:\\.|[^`\\])*`")
_DOUBLE, _SINGLE, _COMMENT = r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\])*'", r"/\*.*?\*/|//.*"
_TOKEN_SQL = {
    "python": rf"[rRbBuUfFtT]{{0,2}}(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'{{3}}(?:\\.|[^\\])*?'{{3}}|(\"\"\"|'{{3}}).*|{_DOUBLE}|{_SINGLE}|([\"']).*)|#.*|\w+|[^\w\"'#]+",
    "java": rf"\"\"\"(?:\\.|[^\\])*?\"\"\"|(\"\"\").*|{_DOUBLE}|{_SINGLE}|{_COMMENT}|([\"']|/\*).*|[^\"'/]+|/",
    "javascript": rf"{_DOUBLE}|{_SINGLE}|`(?:\\.|[^`\\])*`|{_COMMENT}|([\"'`])(?:).*|(/\*).*|[^\"'`/]+|/",
    "c": rf"(?:u8|[uUL])?(?:{_DOUBLE}|{_SINGLE})|{_COMMENT}|([\"'])(?:).*|(/\*).*|\w+|[^\w\"'/]+|/",
}


def _tokens(text: str, group: int) -> str:
    return "CASE language " + " ".join(f"WHEN '{k}' THEN regexp_extract_all({text}, {_s(v)}, {group})" for k, v in _TOKEN_SQL.items() if k != "c") + f" ELSE regexp_extract_all({text}, {_s(_TOKEN_SQL['c'])}, {group}) END"


def _ends(text: str) -> str:
    """State at the end of a text that begins in code."""
    opener = f"(coalesce(({_tokens(text, 1)})[-1], '') || coalesce(({_tokens(text, 2)})[-1], ''))"
    odd = f"length(regexp_extract({text}, '(\\\\*)$', 1)) % 2 = 1"
    return f"""CASE {opener} WHEN '' THEN 0 WHEN repeat(chr(34), 3) THEN 1 WHEN repeat(chr(39), 3) THEN 2 WHEN '"' THEN CASE WHEN {odd} THEN 3 ELSE 0 END WHEN chr(39) THEN CASE WHEN {odd} THEN 4 ELSE 0 END WHEN '/*' THEN 5 WHEN '`' THEN 6 END"""


def _pruned(view: str) -> list[str]:
    """CTE pr: language, code and first line of the statement of each line of a view."""
    rests = ", ".join(f"CASE WHEN regexp_matches(line, {_s(c)}) THEN regexp_replace(line, {_s(c)}, '') END" for c in _CLOSES)
    odd = r"length(regexp_extract(line, '(\\*)$', 1)) % 2 = 1"
    stay = ["1", "2", f"CASE WHEN {odd} THEN 3 ELSE 0 END", f"CASE WHEN {odd} THEN 4 ELSE 0 END", "5", "6"]
    acts = ", ".join([_ends("line"), *(f"CASE WHEN r[{i}] IS NULL THEN {stay[i - 1]} ELSE {_ends(f'r[{i}]')} END" for i in range(1, 7))])
    content = """CASE WHEN (starts_with(y, repeat(chr(34), 3)) OR starts_with(y, repeat(chr(39), 3))) THEN substr(y, 4, length(y) - 6) ELSE substr(y, 2, length(y) - 2) END"""
    literal = f"""'"' || hex(list_transform([regexp_replace(x, '^[A-Za-z0-9]*', '')], lambda y: {content})[1]) || '"'"""
    masked = f"""CASE WHEN i = len(tk) AND op <> '' THEN CASE WHEN starts_with(x, '/*') THEN '' ELSE '""' END WHEN starts_with(x, '/*') THEN ' ' WHEN starts_with(x, '//') OR (language = 'python' AND starts_with(x, '#')) THEN '' WHEN regexp_matches(x, '^[A-Za-z0-9]{{0,2}}["''`]') THEN {literal} ELSE x END"""
    fresh = r"(language = 'python' AND regexp_matches(code, '^(?:def|class|async\s+def)\b|^@\w'))"
    return [
        f"p1 AS (SELECT file_path, line_no, coalesce(line, '') AS line, {_LANGUAGE} AS language, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS rn FROM {view})",
        f"p2 AS MATERIALIZED (SELECT *, [{acts}] AS act FROM (SELECT *, [{rests}] AS r FROM p1))",
        "p3(file_path, rn, st) AS (SELECT file_path, rn, 0 FROM p2 WHERE rn = 1 UNION ALL SELECT p2.file_path, p2.rn, q.act[st + 1] FROM p3 JOIN p2 q USING (file_path, rn) JOIN p2 ON p2.file_path = p3.file_path AND p2.rn = p3.rn + 1)",
        "p4 AS (SELECT *, CASE WHEN st = 0 THEN line ELSE coalesce(r[st], '') END AS rest FROM p2 JOIN p3 USING (file_path, rn))",
        f"p5 AS (SELECT *, {_tokens('rest', 0)} AS tk, coalesce(({_tokens('rest', 1)})[-1], '') || coalesce(({_tokens('rest', 2)})[-1], '') AS op FROM p4)",
        f"p6 AS MATERIALIZED (SELECT *, CASE WHEN st = 5 AND rest <> '' THEN ' ' ELSE '' END || coalesce(array_to_string(list_transform(tk, lambda x, i: {masked}), ''), '') AS code FROM p5)",
        "b1 AS (SELECT file_path, rn, k, CASE WHEN regexp_matches(c, '[(\\[{]') THEN 1 ELSE -1 END AS v FROM (SELECT file_path, rn, unnest(m) AS c, generate_subscripts(m, 1) AS k FROM (SELECT file_path, rn, regexp_extract_all(code, CASE WHEN language = 'python' THEN '[()\\[\\]{}]' ELSE '[()\\[\\]]' END) AS m FROM p6)))",
        "b2 AS (SELECT file_path, rn, sum(v) AS add, least(0, min(run)) AS low FROM (SELECT *, sum(v) OVER (PARTITION BY file_path, rn ORDER BY k) AS run FROM b1) GROUP BY ALL)",
        f"b3 AS MATERIALIZED (SELECT p6.*, coalesce(add, 0) AS add, coalesce(add, 0) - coalesce(low, 0) AS least, regexp_matches(code, '\\\\$') AS j, {fresh} AS fresh FROM p6 LEFT JOIN b2 USING (file_path, rn))",
        "b4(file_path, rn, depth, joined) AS (SELECT file_path, rn, CAST(0 AS HUGEINT), false FROM b3 WHERE rn = 1 UNION ALL SELECT b3.file_path, b3.rn, CASE WHEN q.fresh THEN q.least ELSE greatest(depth + q.add, q.least) END, q.j FROM b4 JOIN b3 q USING (file_path, rn) JOIN b3 ON b3.file_path = b4.file_path AND b3.rn = b4.rn + 1)",
        "pr AS MATERIALIZED (SELECT file_path, line_no, line, language, code, coalesce(last_value(CASE WHEN (fresh OR (depth <= 0 AND NOT joined)) AND st NOT IN (1, 2, 3, 4, 6) THEN line_no END IGNORE NULLS) OVER (PARTITION BY file_path ORDER BY line_no), line_no) AS start FROM b3 JOIN b4 USING (file_path, rn))",
    ]


_KEYWORD = r"'^([A-Za-z_]\w*)\s*=([^=].*)?$'"
_CALLS = [
    r"s1 AS MATERIALIZED (SELECT file_path, language, start, regexp_replace(string_agg(chr(1) || line_no || chr(2) || regexp_replace(code, '\\$', ' '), '' ORDER BY line_no), '\b(def|class)\s+\w+', '\1 ', 'g') AS t, string_agg(regexp_replace(code, '\\$', ' '), ' ' ORDER BY line_no) AS code FROM pr WHERE code <> '' GROUP BY ALL)",
    r"s2 AS (SELECT file_path, start, p, substr(t, p, 1) AS c FROM (SELECT file_path, start, t, unnest(range(1, length(t) + 1)) AS p FROM s1) WHERE substr(t, p, 1) IN ('(', '[', '{', ')', ']', '}', ','))",
    r"s3 AS MATERIALIZED (SELECT *, sum(CASE WHEN c IN ('(', '[', '{') THEN 1 WHEN c = ',' THEN 0 ELSE -1 END) OVER (PARTITION BY file_path, start ORDER BY p) AS d FROM s2)",
    r"s4 AS (SELECT s1.*, o.p, o.d, (SELECT min(z.p) FROM s3 z WHERE z.file_path = o.file_path AND z.start = o.start AND z.p > o.p AND z.d < o.d) AS z, regexp_extract(substr(t, 1, o.p - 1), '(?:([A-Za-z_][\w.]*)\.)?([A-Za-z_]\w*)$', 1) AS m, regexp_extract(substr(t, 1, o.p - 1), '(?:([A-Za-z_][\w.]*)\.)?([A-Za-z_]\w*)$', 2) AS function FROM s3 o JOIN s1 USING (file_path, start) WHERE o.c = '(')",
    r"s5 AS (SELECT *, coalesce(z, length(t) + 1) AS e, CAST(regexp_extract(substr(t, 1, p - length(function) - CASE WHEN m = '' THEN 0 ELSE length(m) + 1 END - 1), '.*' || chr(1) || '(\d+)' || chr(2), 1) AS INT) AS line_no, row_number() OVER (PARTITION BY file_path, start ORDER BY p) - 1 AS pos FROM s4 WHERE function <> '')",
    r"s6 AS (SELECT s5.*, list_sort(list_concat([p, e], coalesce((SELECT list(x.p) FROM s3 x WHERE x.file_path = s5.file_path AND x.start = s5.start AND x.c = ',' AND x.p > s5.p AND x.p < s5.e AND x.d = s5.d), []))) AS cut FROM s5)",
    r"s7 AS (SELECT *, list_filter(list_transform(range(1, len(cut)), lambda i: trim(regexp_replace(substr(t, cut[i] + 1, cut[i + 1] - cut[i] - 1), chr(1) || '\d+' || chr(2), ' ', 'g'))), lambda x: x <> '') AS parts FROM s6)",
    rf"""st AS (SELECT s7.file_path, s7.line_no, s7.language, s7.code, nullif(m, '') AS module, function, pos, line, list_transform(list_filter(parts, lambda x: NOT regexp_matches(x, {_KEYWORD})), lambda x: CASE WHEN regexp_matches(x, '^"[0-9A-F]*"$') THEN decode(unhex(substr(x, 2, length(x) - 2))) ELSE x END) AS args, list_filter(parts, lambda x: regexp_matches(x, {_KEYWORD})) AS keywords FROM s7 JOIN pr ON pr.file_path = s7.file_path AND pr.line_no = s7.line_no)""",
]
_LIST = lambda xs: "[" + ", ".join(map(_s, xs)) + "]" if xs else "CAST(NULL AS VARCHAR[])"
_RULES = "dr(ord, rule_id, lang, kind, rm, fn, algorithm, purpose, confidence, vals, role, size, sarg, skw) AS (VALUES " + ", ".join("(" + ", ".join([*map(_s, (i, *r)), _LIST(D.VALUES.get(r[0])), *map(_s, (D.ROLES.get(r[0], "any"), D.SIZES.get(r[0]), D.SIZE_ARGUMENTS.get(r[0]), D.SIZE_KEYWORDS.get(r[0])))]) + ")" for i, r in enumerate(D.RULES)) + ")"
_NID = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(upper(args[1]), '{x}')" for x in xs) + f" THEN '{c}'" for c, xs in D.CURVES) + " END"
_CLASS = "CASE WHEN contains(upper(args[1]), 'SECP256R1') THEN 'P256' WHEN contains(upper(args[1]), 'SECP384R1') THEN 'P384' WHEN contains(upper(args[1]), 'SECP521R1') THEN 'P521' WHEN contains(upper(args[1]), 'SECP256K1') THEN 'K256' WHEN contains(upper(args[1]), 'BRAINPOOLP256R1') THEN 'BRAINPOOLP256R1' END"
_MATCHED = [
    _RULES,
    "m1 AS (SELECT st.*, rule_id, kind, rm, fn, algorithm, purpose, confidence, vals, size, sarg, skw FROM st JOIN dr ON st.language = dr.lang AND kind <> 'c_symbol' AND (fn = function OR (ends_with(fn, '*') AND starts_with(function, rtrim(fn, '*')))))",
    r"m2 AS (SELECT *, CASE WHEN kind = 'call_chain' THEN coalesce(try_cast(args[sarg + 1] AS INT), try_cast(trim(regexp_extract(list_filter(keywords, lambda x: regexp_extract(x, '^([A-Za-z_]\w*)\s*=([^=].*)?$', 1) = skw)[1], '^([A-Za-z_]\w*)\s*=([^=].*)?$', 2)) AS INT), size) ELSE size END AS key_size, CASE WHEN algorithm = 'ECDSA' AND fn = 'generate_private_key' THEN " + _CLASS + f" WHEN fn IN ('EC_KEY_new_by_curve_name', 'EVP_PKEY_CTX_set_ec_paramgen_curve_nid') THEN {_NID} END AS curve FROM m1 WHERE (kind = 'call_chain' AND (rm IS NULL OR CASE WHEN NOT contains(module, '.') THEN module WHEN language = 'python' THEN function END = rm)) OR (kind = 'call_with_arg' AND list_contains(vals, args[1])))",
    "mc AS (SELECT file_path, line_no, pos, rule_id, kind, algorithm, purpose, confidence, key_size, curve, function AS symbol, code, line FROM m2)",
    r"""y1 AS (SELECT file_path, line_no, code, line, regexp_extract_all(regexp_replace(code, '"[0-9A-F]*"', '""', 'g'), '[A-Za-z_]\w*\s*\(?') AS t, language, regexp_matches(code, '^\s*#') AS mac FROM pr WHERE language IS NOT NULL)""",
    r"y2 AS (SELECT *, regexp_extract(t[i], '^\w+') AS symbol, ends_with(t[i], '(') AS called, i - 1 AS pos FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM y1))",
    r"ms AS (SELECT file_path, line_no, pos, rule_id, kind, algorithm, purpose, confidence, CAST(NULL AS INT) AS key_size, CAST(NULL AS VARCHAR) AS curve, symbol, code, line FROM y2 JOIN dr ON language = lang AND kind = 'c_symbol' AND fn = symbol WHERE role = 'any' OR (role = 'constant' AND NOT called AND (upper(symbol) = symbol OR regexp_matches(symbol, '^(NID_|OBJ_|EVP_)'))))",
    "mm AS (SELECT * FROM mc UNION ALL SELECT * FROM ms)",
]
_SITES = [*ctes("source_lines"), *_pruned("source_lines"), *_CALLS]
_FOUND = [*_SITES, *_MATCHED]
_NAMED = "CASE WHEN curve IS NOT NULL THEN algorithm || '-' || curve WHEN key_size IS NOT NULL THEN algorithm || '-' || key_size ELSE algorithm END"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "source_lines")


def found(spark: SparkSession, d: str) -> DataFrame:
    return T.detect(lines(spark, d), load_detection_rules(spark))


# Rules and sources


@query(_with([*ctes("source_lines"), _RULES, f"fl AS (SELECT DISTINCT file_path, {_LANGUAGE} AS language FROM source_lines)"], "SELECT file_path, rule_id FROM fl JOIN dr ON lang = language"))
def a02_rules_of_files(spark: SparkSession, d: str) -> DataFrame:
    files = lines(spark, d).select("file_path", language_of(F.col("file_path")).alias("language")).distinct()
    return T.applicable_rules(files, load_detection_rules(spark)).select("file_path", "rule_id")


_BAD = "b AS (SELECT p_partkey AS k, concat('X', p_partkey % 50) AS rule_id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'f' END AS fn, CASE p_partkey % 4 WHEN 0 THEN 'call_chain' WHEN 1 THEN 'call_with_arg' ELSE 'guess' END AS kind, CASE WHEN p_partkey % 5 = 0 THEN 'nonsense' ELSE 'mac' END AS purpose, p_partkey % 7 / 5.0 AS confidence FROM part)"


@query(_with([_BAD], "SELECT rule_id, problem, count(*) AS n FROM (SELECT rule_id, 'duplicate id' AS problem FROM b GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT rule_id, 'missing field' FROM b WHERE fn IS NULL UNION ALL SELECT rule_id, 'confidence out of range' FROM b WHERE confidence > 1 UNION ALL SELECT rule_id, 'unknown purpose' FROM b WHERE purpose = 'nonsense' UNION ALL SELECT rule_id, 'unknown match type' FROM b WHERE kind = 'guess' UNION ALL SELECT rule_id, 'no argument values' FROM b WHERE kind = 'call_with_arg') GROUP BY ALL"))
def a01_rule_problems(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    x = spark.read.parquet(f"{d}/part.parquet").select(
        F.concat(F.lit("X"), (k % 50).cast("string")).alias("rule_id"),
        F.when(k % 3 != 0, "f").alias("rule_function"),
        F.when(k % 4 == 0, "call_chain").when(k % 4 == 1, "call_with_arg").otherwise("guess").alias("kind"),
        F.lit("A").alias("algorithm"),
        F.when(k % 5 == 0, "nonsense").otherwise("mac").alias("purpose"),
        ((k % 7) / F.lit(5.0)).alias("confidence"),
        F.lit(None).cast("array<string>").alias("arg_values"),
    )
    return detection_problems(x).groupBy("rule_id", "problem").agg(F.count("*").alias("n"))


@query(_with([*ctes("source_lines")], f"SELECT {_LANGUAGE} AS language, count(*) AS n FROM source_lines GROUP BY 1"))
def a10_languages(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).groupBy(language_of(F.col("file_path")).alias("language")).agg(F.count("*").alias("n"))


# Extraction


@query(_with([*_SITES[: -len(_CALLS)]], "SELECT file_path, line_no, language, code, start FROM pr"))
def b02_pruned(spark: SparkSession, d: str) -> DataFrame:
    return L.statements(lines(spark, d)).select("file_path", "line_no", "language", "code", "start")


@query(_with([*ctes("code_lines"), *_pruned("code_lines"), *_CALLS], "SELECT file_path, line_no, pos, language, module, function, array_to_string(args, '|') AS args FROM st"))
def b01_call_sites(spark: SparkSession, d: str) -> DataFrame:
    x = T.call_sites(load(spark, d, "code_lines"))
    return x.select("file_path", "line_no", F.col("pos").cast("long").alias("pos"), "language", "module", "function", F.array_join("args", "|").alias("args"))


@query(_with([*ctes("code_lines"), *_pruned("code_lines"), *_CALLS, *_MATCHED], f"SELECT file_path, line_no, rule_id, {_NAMED} AS algorithm FROM mc WHERE kind = 'call_chain'"))
def b04_match_calls(spark: SparkSession, d: str) -> DataFrame:
    x = T.match_calls(T.call_sites(load(spark, d, "code_lines")), load_detection_rules(spark).filter("kind = 'call_chain'"))
    return x.select("file_path", "line_no", "rule_id", X.canonical(F.col("algorithm"), F.col("key_size"), F.col("curve")).alias("algorithm"))


@query(_with(_FOUND, "SELECT file_path, line_no, rule_id, algorithm FROM mc WHERE kind = 'call_with_arg'"))
def b05_call_with_arg(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d).filter("kind = 'call_with_arg'").select("file_path", "line_no", "rule_id", "algorithm")


@query(_with(_FOUND, "SELECT file_path, line_no, CAST(pos AS BIGINT) AS pos, rule_id, symbol FROM ms"))
def b06_symbols(spark: SparkSession, d: str) -> DataFrame:
    x = T.match_symbols(lines(spark, d), load_detection_rules(spark))
    return x.select("file_path", "line_no", F.col("pos").cast("long").alias("pos"), "rule_id", F.col("observed_symbol").alias("symbol"))


@query(_with(_FOUND, "SELECT file_path, line_no, rule_id, kind, algorithm, purpose, confidence, symbol, key_size, curve FROM mm"))
def b07_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d).select("file_path", "line_no", "rule_id", "kind", "algorithm", "purpose", "confidence", F.col("observed_symbol").alias("symbol"), "key_size", "curve")


@query(_with(_SITES, "SELECT file_path, line_no, function, array_to_string(args, '|') AS args, array_to_string(keywords, '|') AS keywords FROM st"))
def b08_arguments(spark: SparkSession, d: str) -> DataFrame:
    return T.call_sites(lines(spark, d)).select("file_path", "line_no", "function", F.array_join("args", "|").alias("args"), F.array_join("keywords", "|").alias("keywords"))


@query(_with(_SITES, r"""SELECT file_path, line_no, CAST(pos AS BIGINT) AS pos, array_to_string(list_filter(i, lambda x, k: list_position(i, x) = k)[1:8], ',') AS siblings, substr(line, 1, 512) AS snippet FROM (SELECT *, list_filter(regexp_extract_all(regexp_replace(code, '"[0-9A-F]*"', '""', 'g'), '[A-Za-z_]\w*'), lambda x: length(x) < 80) AS i FROM st)"""))
def b11_siblings(spark: SparkSession, d: str) -> DataFrame:
    return T.call_sites(lines(spark, d)).select("file_path", "line_no", F.col("pos").cast("long").alias("pos"), F.array_join("siblings", ",").alias("siblings"), "snippet")


@query(_with(_FOUND, f"SELECT file_path || ':' || line_no AS location, rule_id, {_NAMED} AS algorithm, round(least(1.0, confidence + CASE WHEN key_size IS NULL THEN 0 ELSE 0.01 END), 4) AS confidence, CASE WHEN purpose = 'unknown' THEN 'needs_enrichment' ELSE 'resolved' END AS ambiguity_status, 'application' AS classification, 'internal' AS sensitivity, 'low' AS criticality, 'active' AS lifecycle_stage FROM mm"))
def c04_assets(spark: SparkSession, d: str) -> DataFrame:
    return T.to_assets(found(spark, d)).select("location", "rule_id", "algorithm", "confidence", "ambiguity_status", "classification", "sensitivity", "criticality", "lifecycle_stage")


@query(_with([*ctes("findings")], "SELECT seq, CASE WHEN seq % 6 = 0 THEN 'unknown' WHEN seq % 6 = 1 THEN 'certificate' ELSE purpose END AS purpose FROM findings"))
def c02_purposes(spark: SparkSession, d: str) -> DataFrame:
    p = F.when(F.col("seq") % 6 == 0, "protocol").when(F.col("seq") % 6 == 1, "Certificate").otherwise(F.upper("purpose"))
    return load(spark, d, "findings").select("seq", X.coerce_purpose(p).alias("purpose"))


@query(_with([*ctes("findings")], "SELECT seq % 4 = 0 OR line_number < 4 AS bad, count(*) AS n FROM findings GROUP BY 1"))
def c08_split(spark: SparkSession, d: str) -> DataFrame:
    f = load(spark, d, "findings").withColumns({"line_number": F.col("line_number") - 3, "confidence": F.when(F.col("seq") % 4 == 0, 1.5).otherwise(F.col("confidence"))})
    good, bad = T.split_good(f, X.violations(f))
    return good.select(F.lit(False).alias("bad")).union(bad.select(F.lit(True))).groupBy("bad").agg(F.count("*").alias("n"))


_PEERS = "pe AS (SELECT h.event_id, h.endpoint, h.event_id % 9 = 0 AS failed, CASE h.event_id % 8 WHEN 0 THEN 'RSA' WHEN 1 THEN 'EC' WHEN 2 THEN 'X448' WHEN 3 THEN 'Ed448' WHEN 4 THEN 'GOST' WHEN 5 THEN 'DSA' WHEN 6 THEN 'X25519' ELSE 'EC' END AS pk_type, CASE WHEN h.event_id % 16 < 8 THEN 2048 ELSE 3072 END AS key_size, CASE WHEN h.event_id % 8 = 1 THEN 'secp521r1' WHEN h.event_id % 8 = 7 THEN 'sect571k1' END AS curve, CASE h.event_id % 5 WHEN 0 THEN 'md5' WHEN 1 THEN 'SHA1' WHEN 2 THEN 'sha256' END AS sig_hash FROM handshakes h)"


def peers(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "handshakes")
    return spark.sql("WITH " + _PEERS + " SELECT * FROM pe")


_KEY = "CASE pk_type WHEN 'RSA' THEN concat('RSA-', key_size) WHEN 'DSA' THEN concat('DSA-', key_size) WHEN 'EC' THEN CASE curve WHEN 'secp521r1' THEN 'ECDSA-P521' ELSE 'ECDSA-SECT571K1' END WHEN 'GOST' THEN NULL ELSE pk_type END"


@query(_with([*ctes("handshakes"), _PEERS], f"SELECT * FROM (SELECT event_id, 'I-100' AS rule_id, {_KEY} AS algorithm, CASE WHEN pk_type IN ('RSA', 'X25519', 'X448') THEN 'key_establishment' ELSE 'digital_signature' END AS purpose, 0.97 AS confidence, 'critical' AS sensitivity, true AS reachable, 'tls://' || endpoint AS location FROM pe WHERE NOT failed UNION ALL SELECT event_id, 'I-101', CASE lower(sig_hash) WHEN 'md5' THEN 'MD5' WHEN 'sha1' THEN 'SHA-1' END, 'hashing', 0.95, 'high', true, 'tls://' || endpoint FROM pe WHERE NOT failed) WHERE algorithm IS NOT NULL"))
def b17_peer_assets(spark: SparkSession, d: str) -> DataFrame:
    return X.peer_assets(peers(spark, d)).select("event_id", "rule_id", "algorithm", "purpose", "confidence", "sensitivity", "reachable", "location")


@query(_with([*ctes("handshakes"), _PEERS], "SELECT count(*) AS endpoints_probed, count(*) FILTER (failed OR event_id % 10 = 3) AS endpoints_failed FROM pe"))
def b18_probe_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.probe_counts(peers(spark, d).withColumn("endpoint", F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("https://"), "endpoint")).otherwise(F.col("endpoint"))))


@query(_with([*ctes("handshakes"), _PEERS], f"SELECT event_id, {_KEY} AS algorithm FROM pe WHERE pk_type <> 'GOST'"))
def b20_public_keys(spark: SparkSession, d: str) -> DataFrame:
    algorithm, _ = X.public_key(F.col("pk_type"), F.col("key_size"), F.col("curve"))
    return peers(spark, d).select("event_id", algorithm.alias("algorithm")).filter("algorithm IS NOT NULL")


# Enrichment

_PROHIBITED = "[" + ", ".join(f"'{k}'" for k in R.PROHIBITED) + "]"
_J = "(CASE WHEN json_valid(raw) THEN raw END)"
_REASON = (
    "CASE WHEN octet_length(encode(raw)) > 2048 THEN 'too long' WHEN NOT json_valid(raw) OR json_type(CASE WHEN json_valid(raw) THEN raw ELSE 'null' END) <> 'OBJECT' THEN 'not a JSON object'"
    f" WHEN len(list_intersect(json_keys({_J}), {_PROHIBITED})) > 0 THEN 'prohibited field' WHEN len(list_filter(json_keys({_J}), lambda x: x NOT IN ('purpose', 'confidence', 'algorithm_hint', 'context_notes'))) > 0 THEN 'unknown field'"
    f" WHEN coalesce(json_extract_string({_J}, '$.purpose'), '') NOT IN ({', '.join(map(_s, R.PURPOSES))}) THEN 'unknown purpose'"
    f" WHEN coalesce(json_type({_J}, '$.confidence'), 'NULL') NOT IN ('DOUBLE', 'UBIGINT', 'BIGINT') OR NOT coalesce(try_cast(json_extract_string({_J}, '$.confidence') AS DOUBLE) BETWEEN 0 AND 1, false) THEN 'confidence out of range'"
    f" WHEN length(json_extract_string({_J}, '$.algorithm_hint')) > 100 THEN 'bad hint' WHEN length(json_extract_string({_J}, '$.context_notes')) > 500 THEN 'bad notes' END"
)


@query(_with(ctes("responses"), f"SELECT event_id, {_REASON} AS reason FROM responses"))
def e09_validate(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "responses").select("event_id", X.validate_response(F.col("raw")).alias("reason"))


_GATE = "(purpose = 'unknown' AND finding_type = 'deterministic' AND length(snippet) > 0)"


@query(_with([*ctes("observed")], f"SELECT seq, snippet, 'llm:' || sha256(snippet || '|v1') AS cache_key FROM observed WHERE {_GATE}"))
def e01_requests(spark: SparkSession, d: str) -> DataFrame:
    return E.requests(load(spark, d, "observed")).select("seq", "snippet", "cache_key")


_CACHE = [*ctes("observed", "stored_answers"), f"aq AS (SELECT seq, snippet FROM observed WHERE {_GATE})", f"sa AS (SELECT snippet, arg_max(raw, (stored_at, raw)) AS raw FROM stored_answers WHERE json_valid(raw) AND stored_at <= TIMESTAMP '{AS_OF}' AND stored_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1)", "ca AS (SELECT seq, aq.snippet, raw FROM aq LEFT JOIN sa ON aq.snippet = sa.snippet)"]


def cached(spark: SparkSession, d: str) -> DataFrame:
    stored = load(spark, d, "stored_answers").select(X.cache_key(F.col("snippet")).alias("cache_key"), "stored_at", "raw")
    return E.cached(E.requests(load(spark, d, "observed")), stored, AS_OF)


@query(_with(_CACHE, "SELECT seq, raw, raw IS NOT NULL AS hit FROM ca"))
def e08_cached(spark: SparkSession, d: str) -> DataFrame:
    return cached(spark, d).select("seq", "raw", "hit")


@query(_with(_CACHE, "SELECT DISTINCT snippet FROM ca WHERE raw IS NULL"))
def e08_to_send(spark: SparkSession, d: str) -> DataFrame:
    return E.to_send(cached(spark, d)).select("snippet")


_APPLIED = [*_CACHE, f"ok AS (SELECT seq, raw, {_REASON} AS reason FROM ca WHERE raw IS NOT NULL)", "ay AS (SELECT o.*, reason, raw IS NOT NULL AND reason IS NULL AS good, raw FROM observed o LEFT JOIN ok ON o.seq = ok.seq)", "ae AS (SELECT seq, scan_id, algorithm, source_surface, file_path, line_number, CASE WHEN good THEN json_extract_string(raw, '$.purpose') ELSE purpose END AS purpose, CASE WHEN good THEN round(CAST(json_extract_string(raw, '$.confidence') AS DOUBLE), 4) ELSE confidence END AS confidence, CASE WHEN good THEN 'llm_enriched' ELSE finding_type END AS finding_type, good AND CAST(json_extract_string(raw, '$.confidence') AS DOUBLE) < 0.4 AS low_confidence, reason, good, snippet FROM ay)"]


@query(_with(_APPLIED, "SELECT seq, purpose, confidence, finding_type, coalesce(low_confidence, false) AS low_confidence, reason FROM ae"))
def e11_apply(spark: SparkSession, d: str) -> DataFrame:
    x = E.apply(load(spark, d, "observed"), cached(spark, d))
    return x.select("seq", "purpose", "confidence", "finding_type", F.coalesce("low_confidence", F.lit(False)).alias("low_confidence"), "reason")


@query(_with(_APPLIED, "SELECT count(*) AS total, count(*) FILTER (good) AS enriched, (SELECT count(*) FROM ca) AS attempted, (SELECT count(raw) FROM ca) AS cache_hits, (SELECT count(*) FROM ca) - count(*) FILTER (good) AS failed, count(*) - (SELECT count(*) FROM ca) AS skipped, round(count(*) FILTER (good) / CAST((SELECT count(*) FROM ca) AS DOUBLE), 4) AS success_rate FROM ae"))
def e12_batch_stats(spark: SparkSession, d: str) -> DataFrame:
    asked = cached(spark, d)
    return E.batch_stats(asked, E.apply(load(spark, d, "observed"), asked))


# Call graph from code

_SCOPED = [
    *ctes("source_lines"),
    *_pruned("source_lines"),
    r"g1 AS MATERIALIZED (SELECT file_path, line_no, code, length(regexp_extract(code, '^(\s*)', 1)) AS ind, regexp_matches(code, '^\s*class\s+\w+') AS cls, nullif(regexp_extract(code, '^\s*(?:class|(?:async\s+)?def)\s+(\w+)', 1), '') AS name, nullif(regexp_extract(code, '^\s*@((?:\w+\.)*\w+)', 1), '') AS deco, replace(regexp_replace(file_path, '\.[A-Za-z]+$', ''), '/', '.') AS module FROM pr WHERE language = 'python' AND start = line_no AND trim(code) <> '')",
    # Definitions around a line: earlier, less indented, and nothing since that is indented no deeper.
    "g2 AS (SELECT x.file_path, x.line_no, list(y.name ORDER BY y.line_no) AS around FROM g1 x JOIN g1 y ON x.file_path = y.file_path AND y.line_no < x.line_no AND y.name IS NOT NULL AND y.ind < x.ind WHERE NOT EXISTS (SELECT 1 FROM g1 z WHERE z.file_path = x.file_path AND z.line_no > y.line_no AND z.line_no < x.line_no AND z.ind <= y.ind) GROUP BY ALL)",
    "g3 AS (SELECT *, coalesce(sum(CASE WHEN deco IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM g1 LEFT JOIN g2 USING (file_path, line_no))",
    "g4 AS (SELECT *, list(deco) FILTER (deco IS NOT NULL) OVER (PARTITION BY file_path, run ORDER BY line_no) AS decorators, CASE WHEN around IS NOT NULL THEN concat_ws('.', module, array_to_string(around, '.')) END AS scope FROM g3)",
]
_NAMES = "(name IN (" + ", ".join(map(_s, R.ENTRY_NAMES)) + ") OR starts_with(lower(name), 'handle_') OR starts_with(lower(name), 'on_') OR starts_with(lower(name), 'process_'))"
_ROUTED = "len(list_filter(coalesce(decorators, []), lambda x: regexp_matches(split_part(x, '.', -1), " + _s(R.ROUTES) + "))) > 0"
_FUNCTIONS = [*_SCOPED, f"fu AS (SELECT concat_ws('.', coalesce(scope, module), name) AS qualified_name, file_path, line_no AS start_line, CASE WHEN {_ROUTED} THEN 'route decorator: @' || decorators[1] WHEN {_NAMES} THEN 'entry-point function name: ' || name END AS reason FROM g4 WHERE name IS NOT NULL AND NOT cls)"]
_EDGES = [
    *_FUNCTIONS,
    *_CALLS,
    "ed AS (SELECT g4.scope AS caller, CASE WHEN m = '' THEN module || '.' || function ELSE m || '.' || function END AS callee, s5.line_no AS call_line FROM s5 JOIN g4 ON g4.file_path = s5.file_path AND g4.line_no = s5.start WHERE g4.scope IS NOT NULL AND g4.name IS NULL)",
]
_GRAPH = [*_EDGES, "er AS (SELECT DISTINCT caller, callee, callee NOT IN (SELECT qualified_name FROM fu) AS external FROM ed)", "nd AS (SELECT qualified_name AS node FROM fu UNION SELECT caller FROM er UNION SELECT callee FROM er)"]


@query(_with(_FUNCTIONS, "SELECT qualified_name, file_path, start_line, reason IS NOT NULL AS is_entry_point, reason AS entry_reason FROM fu"))
def g01_functions(spark: SparkSession, d: str) -> DataFrame:
    return G.functions_of(lines(spark, d))


@query(_with(_EDGES, "SELECT caller, callee, call_line FROM ed"))
def g02_call_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.call_edges(lines(spark, d))


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return G.assemble(*G.code_graph(lines(spark, d)))


@query(_with(_GRAPH, "SELECT (SELECT count(*) FROM nd) AS nodes, (SELECT count(*) FROM er) AS edges, (SELECT count(*) FROM fu WHERE reason IS NOT NULL) AS entry_points, (SELECT count(*) FROM nd WHERE node NOT IN (SELECT qualified_name FROM fu)) AS external_nodes"))
def g06_graph(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_counts(*graph(spark, d))


@query(_with(_GRAPH, "SELECT qualified_name AS entry_point FROM fu WHERE reason IS NOT NULL"))
def g12_entries(spark: SparkSession, d: str) -> DataFrame:
    return G.entry_list(graph(spark, d)[0])


_WALKS = [*_GRAPH, "wa(source, node, depth, path) AS (SELECT qualified_name, qualified_name, 0, [qualified_name] FROM fu UNION ALL SELECT source, callee, depth + 1, list_append(path, callee) FROM wa JOIN er ON caller = node WHERE NOT list_contains(path, callee))"]


@query(_with(_WALKS, "SELECT w.source, w.node AS target, min(depth) AS depth, array_to_string(arg_min(path, (depth, path)), ' ') AS path FROM wa w JOIN fu a ON a.qualified_name = w.source JOIN fu b ON b.qualified_name = w.node AND a.file_path = b.file_path GROUP BY ALL"))
def g07_paths(spark: SparkSession, d: str) -> DataFrame:
    fns, calls = G.code_graph(lines(spark, d))
    edges = G.assemble(fns, calls)[1]
    fns = fns.select("qualified_name", "file_path")
    pairs = fns.withColumnRenamed("qualified_name", "source").join(fns.withColumnRenamed("qualified_name", "target").hint("merge"), "file_path").select("source", "target")
    return G.shortest_paths(edges, pairs).select("source", "target", "depth", F.array_join("path", " ").alias("path"))




@query(_with([*_WALKS, "mq AS (SELECT l.file_path, l.line_no, (SELECT arg_max(qualified_name, (start_line, qualified_name)) FROM fu WHERE fu.file_path = l.file_path AND start_line <= l.line_no) AS function FROM source_lines l)", "rn AS (SELECT node, min(depth) AS depth FROM wa WHERE source IN (SELECT qualified_name FROM fu WHERE reason IS NOT NULL) GROUP BY 1)"], "SELECT mq.file_path, mq.line_no, function, CASE WHEN function IS NULL THEN NULL ELSE depth IS NOT NULL END AS reachable, depth FROM mq LEFT JOIN rn ON node = function"))
def g10_code_verdicts(spark: SparkSession, d: str) -> DataFrame:
    src = lines(spark, d).select("file_path", F.col("line_no").alias("line_number"), F.lit("source_code").alias("source_surface"), F.xxhash64("file_path", "line_no").alias("seq"))
    fns, calls = G.code_graph(lines(spark, d))
    v = G.verdicts(src, fns.withColumn("fn_ord", F.xxhash64("qualified_name")), calls)
    return src.join(v, "seq").select("file_path", F.col("line_number").alias("line_no"), "function", "reachable", "depth")


@query(_with([*ctes("certs")], "SELECT cert_id, CASE WHEN cert_id % 5 = 0 THEN 'kept' WHEN pk_type = 'RSA' THEN 'key-team' WHEN cert_id % 3 = 0 THEN 'null-path' END AS owner FROM certs"))
def f09_owners_kept(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "certs").select("cert_id", F.col("pk_type").alias("algorithm"), F.lit("certificate").alias("source_surface"), F.lit(None).cast("string").alias("purpose"), F.when(F.col("cert_id") % 3 == 0, "x/y").alias("file_path"), F.when(F.col("cert_id") % 5 == 0, "kept").when(F.col("cert_id") % 2 == 0, " ").alias("owner"))
    rules = C.add_owner_rule(load(spark, d, "owner_rules").filter("id < 0"), " key-team ", 9, algorithm_prefix="rsa")
    return C.assign_owners(c, C.add_owner_rule(rules, "null-path", 5, path_contains="X/")).select("cert_id", "owner")

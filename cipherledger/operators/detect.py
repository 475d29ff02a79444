"""Findings from code lines: pruning, call sites, identifiers, rule matches and their shaping into assets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import detection as D
from ..plans import rules as R
from .extract import canonical, coerce_purpose, confidence
from .lexer import arguments, lexed, siblings, statement_calls

IDENTIFIER = r"[A-Za-z_]\w*\s*\(?"
KEYWORD_ARGUMENT = r"^([A-Za-z_]\w*)\s*=([^=].*)?$"
SNIPPET = 512


def positional(args: Column) -> Column:
    """Positional arguments of a masked argument text, literals without their quotes; keyword arguments are left out."""
    plain = F.filter(arguments(args), lambda a: ~a.rlike(KEYWORD_ARGUMENT))
    return F.transform(plain, lambda a: F.when(a.rlike('^"[0-9A-F]*"$'), F.decode(F.unhex(F.substring(a, F.lit(2), F.length(a) - 2)), "UTF-8")).otherwise(a))


def call_sites(lines: DataFrame) -> DataFrame:
    """(file_path, line_no, pos, language, module, function, args, keywords, siblings, snippet) of each call, with all its lines' arguments."""
    return _argued(statement_calls(lines, SNIPPET)).select("file_path", "line_no", "pos", "language", "module", "function", "args", "keywords", "siblings", "snippet")


def _argued(calls: DataFrame) -> DataFrame:
    """Calls with their arguments cut apart: args and keywords beside or in place of raw."""
    if "args" in calls.columns:
        return calls
    keywords = F.filter(arguments(F.col("raw")), lambda a: a.rlike(KEYWORD_ARGUMENT))
    return calls.withColumns({"args": positional(F.col("raw")), "keywords": keywords})


def curve_of(text: Column) -> Column:
    """Curve that a symbol or class name spells, first spelling in order; null without one."""
    up, out = F.upper(text), F.lit(None).cast("string")
    for name, spellings in reversed(D.CURVES):
        out = F.when(reduce(lambda a, b: a | b, [up.contains(s) for s in spellings]), name).otherwise(out)
    return out


def class_curve(text: Column) -> Column:
    up, out = F.upper(text), F.lit(None).cast("string")
    for name in reversed(D.CURVE_CLASSES):
        out = F.when(up.contains(name), name).otherwise(out)
    for name, short in (("SECP256R1", "P256"), ("SECP384R1", "P384"), ("SECP521R1", "P521"), ("SECP256K1", "K256")):
        out = F.replace(out, F.lit(name), F.lit(short))
    return out


#: Letters that the stem of a rule with a star is joined by.
STEM = 3


def _keyed(rules: DataFrame) -> DataFrame:
    """Rules with the key that they are found by: the name, the first letters of a stem, or nothing where the stem is shorter."""
    stem = F.rtrim(F.col("rule_function"), F.lit("*"))
    key = F.when(~F.col("rule_function").endswith("*"), F.concat(F.lit("="), "rule_function")).when(F.length(stem) >= STEM, F.concat(F.lit("^"), F.substring(stem, 1, STEM))).otherwise("")
    return F.broadcast(rules.withColumn("_key", key))


def _keys(name: Column) -> Column:
    """All keys that could be a rule's for a name: itself, its first letters, and the key of shorter stems."""
    return F.array(F.concat(F.lit("="), name), F.concat(F.lit("^"), F.substring(name, 1, STEM)), F.lit(""))


FOUND = ("file_path", "line_no", "pos", "rule_id", "kind", "algorithm", "purpose", "confidence", "key_size", "curve", "observed_symbol", "sibling_symbols", "snippet")


def match_calls(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of the rules over calls, which meet by _keys() in one pass; arguments are cut apart only for calls that meet a rule.

    A call_chain rule asks for its module where it has one; a call_with_arg rule asks for one of its values as first
    argument and not for the module. `rules` is detection_table() or rows like it, a table of fixed size.
    """
    r = _keyed(rules.filter("kind <> 'c_symbol'").withColumnRenamed("language", "rule_language"))
    x = sites.withColumn("_key", F.explode(_keys(F.col("function"))))
    same = (F.col("language") == F.col("rule_language")) & (x["_key"] == r["_key"]) & (~F.col("rule_function").endswith("*") | F.col("function").startswith(F.rtrim(F.col("rule_function"), F.lit("*"))))
    hit = _argued(x.join(r, same).drop("_key"))
    # Of a dotted receiver, Python's tree holds one name beside the attribute, the function's own; the others' holds none.
    receiver = F.when(~F.col("module").contains("."), F.col("module")).when(F.col("language") == "python", F.col("function"))
    chain = (F.col("kind") == "call_chain") & (F.col("rule_module").isNull() | F.coalesce(receiver == F.col("rule_module"), F.lit(False)))
    valued = (F.col("kind") == "call_with_arg") & F.coalesce(F.array_contains("arg_values", F.get("args", F.lit(0))), F.lit(False))
    hit = hit.filter(chain | valued)
    named = F.get(F.filter("keywords", lambda a: F.regexp_extract(a, KEYWORD_ARGUMENT, 1) == F.col("size_keyword")), F.lit(0))
    stated = F.coalesce(F.get("args", F.col("size_argument")).try_cast("int"), F.trim(F.regexp_extract(named, KEYWORD_ARGUMENT, 2)).try_cast("int"))
    size = F.when(F.col("kind") == "call_chain", F.coalesce(stated, F.col("rule_size"))).otherwise(F.col("rule_size"))
    first = F.get("args", F.lit(0))
    by_class = (F.col("algorithm") == "ECDSA") & (F.col("rule_function") == "generate_private_key")
    curve = F.when(by_class, class_curve(first)).when(F.col("rule_function").isin(*D.CURVE_FUNCTIONS), curve_of(first))
    return hit.withColumns({"key_size": size, "curve": curve, "observed_symbol": F.col("function"), "sibling_symbols": F.col("siblings")}).select(*FOUND)


def match_symbols(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of the rules over bare identifiers in the role that a rule asks for: call, macro, constant or any."""
    x = lexed(lines).filter("language IS NOT NULL")
    tokens = F.regexp_extract_all(F.regexp_replace("code", '"[0-9A-F]*"', '""'), F.lit(IDENTIFIER), F.lit(0))
    x = x.select("file_path", "line_no", "language", siblings(F.col("code")).alias("sibling_symbols"), F.substring("line", 1, SNIPPET).alias("snippet"), F.col("code").rlike(r"^\s*#").alias("_macro"), F.posexplode(tokens).alias("pos", "_t"))
    x = x.withColumns({"observed_symbol": F.regexp_extract("_t", r"^\w+", 0), "_call": F.col("_t").endswith("(")})
    r = _keyed(rules.filter("kind = 'c_symbol'").withColumnRenamed("language", "rule_language"))
    stem = F.rtrim(F.col("rule_function"), F.lit("*"))
    x = x.withColumn("_key", F.explode(_keys(F.col("observed_symbol"))))
    same = (F.col("language") == F.col("rule_language")) & (x["_key"] == r["_key"]) & (~F.col("rule_function").endswith("*") | F.col("observed_symbol").startswith(stem))
    constant = ~F.col("_call") & ((F.upper("observed_symbol") == F.col("observed_symbol")) | F.col("observed_symbol").rlike("^(NID_|OBJ_|EVP_)"))
    role = F.when(F.col("role") == "call", F.col("_call")).when(F.col("role") == "macro", F.col("_macro")).when(F.col("role") == "constant", constant).otherwise(F.lit(True))
    hit = x.join(r, same).filter(role).drop("_key")
    none = F.lit(None).cast("int")
    return hit.withColumns({"key_size": none, "curve": F.lit(None).cast("string")}).select(*FOUND)


def detect(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule against every site and symbol; several rules may find one place."""
    return match_calls(call_sites(lines), rules).unionByName(match_symbols(lines, rules))


def rules_for_language(rules: DataFrame, language: str) -> DataFrame:
    return rules.filter(F.col("language") == language.lower())


def applicable_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files (with their language) and the rules for it; the rule table has a fixed size."""
    return files.join(F.broadcast(rules), "language")


def to_assets(found: DataFrame, parse_error: Column | None = None) -> DataFrame:
    """Findings as assets: canonical name, location, confidence, ambiguity and the staging defaults that later stages overwrite."""
    size = F.col("key_size").isNotNull()
    path = F.replace("file_path", F.lit("\\"), F.lit("/"))
    purpose = coerce_purpose(F.col("purpose"))
    return found.select(
        path.alias("file_path"),
        F.col("line_no").cast("int").alias("line_number"),
        F.concat(path, F.lit(":"), F.col("line_no").cast("string")).alias("location"),
        "pos",
        "rule_id",
        canonical(F.col("algorithm"), F.col("key_size"), F.col("curve")).alias("algorithm"),
        purpose.alias("purpose"),
        confidence(F.col("confidence"), size, F.lit(False) if parse_error is None else parse_error).alias("confidence"),
        F.col("key_size").alias("key_size_bits"),
        F.lit("source_code").alias("source_surface"),
        F.lit("deterministic").alias("finding_type"),
        F.when(purpose == "unknown", "needs_enrichment").otherwise("resolved").alias("ambiguity_status"),
        *[F.lit(v).alias(k) for k, v in R.STAGING],
        "observed_symbol",
        "sibling_symbols",
        "snippet",
    )


def split_good(findings: DataFrame, problems: DataFrame, key: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Rows without a problem, and the others: one bad record doesn't stop the rest."""
    bad = problems.select(key).distinct()
    return findings.join(bad, key, "left_anti"), findings.join(bad, key, "left_semi")

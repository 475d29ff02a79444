"""Rule files that users load, and tables of many rules, change answers and keep plans free of loops."""

from __future__ import annotations

import json
import random

import pytest

from cipherledger.operators import classify, extract
from cipherledger.plans import rules as R
from cipherledger.plans import run
from cipherledger.sources import rule_files

RULE = "id long, owner string, priority int, surface string, purpose string, algorithm_prefix string, path_contains string"
ASSET = "seq long, source_surface string, purpose string, algorithm string, file_path string"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_run_with_files(spark, tmp_path):
    def put(name, rows):
        (tmp_path / name).write_text(json.dumps(rows))
        return str(tmp_path / name)

    code = spark.createDataFrame([("pay/a.py", 1, "h = hashlib.md5(x)"), ("pay/a.py", 2, "k = RSA.generate("), ("pay/a.py", 3, "  4096)")], "file_path string, line_no int, line string")
    plain = {r.algorithm: r for r in run.run(code, skip=("reachability",)).assets.collect()}
    weights = [{"factor": f, "weight": 1.0 if f == "cost" else 0.0} for f in R.FACTORS]
    tables = rule_files.load_rule_tables(
        spark,
        classification=put("c.json", [{"priority": 5, "result": "infrastructure", "description": "pay", "file_path_contains": "PAY/"}]),
        mappings=put("m.json", [{"pattern": "rsa-4", "map_purpose": "any", "replacement": "Mine", "path": "hybrid:mine"}, {"pattern": "md", "map_purpose": "hashing", "replacement": "None", "vulnerable": False, "path": "x"}]),
        years=put("y.json", [{"pattern": "*", "years": 7}, {"pattern": "rsa", "migration_type": "*", "years": 12}]),
        profile=put("p.json", {"shelf_life": [{"classification": "infrastructure", "sensitivity": "internal", "years": 30}], "threat": {"default": 20, "late": 40}, "harvest": {"years": 31, "signature_years": 31}}),
        impacts=put("i.json", [{"prefix": "RSA", "purpose": "*", "scores": dict.fromkeys(R.FACTORS, 0.6)}]),
        weights=put("w.json", weights),
        steps=put("s.json", [{"path_type": "hybrid", "steps": ["ask"]}]),
    )
    out = run.run(code, skip=("reachability",), tables=tables)
    mine = {r.algorithm: r for r in out.assets.collect()}
    assert set(plain) == set(mine) == {"MD5", "RSA-4096"} and out.status == "complete"
    rsa, md5 = mine["RSA-4096"], mine["MD5"]
    assert (rsa.classification, rsa.rec_replacement, rsa.x_years, rsa.y_years, rsa.z_years, rsa.composite, rsa.steps) == ("infrastructure", "Mine", 30, 12, 20, 0.6, ["ask"])
    assert (md5.y_years, md5.priority, md5.composite, md5.hndl_flag) == (7, "P4", 0.4, False)
    assert plain["RSA-4096"].rec_replacement != "Mine" and plain["MD5"].priority == "P1"
    assert tables.profile.scenarios == (("late", 40),)
    for bad, what in ((weights[:-1], "weights"), ([{"factor": "cost", "weight": 2.0}], "weights"), ([{"path_type": "hybrid", "steps": []}], "steps")):
        with pytest.raises(ValueError):
            rule_files.load_rule_tables(spark, **{what: put("bad.json", bad)})
    with pytest.raises(ValueError, match="unknown rule tables"):
        rule_files.load_rule_tables(spark, other="x")


def test_many_patterns(spark, tmp_path):
    rules = [(f"P-{i}", f"lib(tool|kit)?_{i}(\\b|_)", "A", "hashing", 0.5) for i in range(10_000)] + [("P-x", "[xy]z|q.r", "B", "mac", 0.5)]
    strings = spark.createDataFrame([("a", 1, "LIBtool_77_x"), ("a", 2, "libkit_77"), ("b", 3, "lib_9999 Q1R"), ("b", 4, None), ("c", 5, "")], "file_path string, pos int, s string")
    found = extract.match_strings(strings, tuple(rules))
    assert {(r.file_path, r.rule_id, r.observed) for r in found.collect()} == {("a", "P-77", "LIBtool_77_x"), ("b", "P-9999", "lib_9999 Q1R"), ("b", "P-x", "lib_9999 Q1R")}
    assert "NestedLoop" not in _plan(found) and "Cartesian" not in _plan(found)
    f = tmp_path / "rules.json"
    f.write_text(json.dumps([{"rule_id": "M", "pattern": "openssl", "algorithm": "A", "purpose": "mac", "confidence": 0.5}]))
    lines = spark.createDataFrame([("i", "Dockerfile", 2, "RUN OpenSSL"), ("i", "Dockerfile", 1, "x")], "image_ref string, manifest string, line_no int, line string")
    assert [(r.rule_id, r.line_no) for r in extract.match_manifests(lines, rules=rule_files.load_patterns(spark, str(f))).collect()] == [("M", 2)]
    assert extract.needed_literal(r"(a|b)RSA_gen\w+x") == "rsa_gen" and extract.needed_literal("a|bcdef") == ""


def test_many_owner_rules(spark):
    r = random.Random(6)
    some = lambda xs: r.choice([None, *xs])
    rules = [(i, f"t{i}", r.randint(0, 9), some(["binary", "source_code"]), some(["mac", "hashing"]), some(["rsa", "RSA-2", "a", ""]), some(["pay", "X/", "auth/m", ""])) for i in range(300)]
    rows = [(i, some(["binary", "source_code"]), some(["mac", "hashing", "other"]), some(["RSA-2048", "rsa", "AES", ""]), some(["pay/x/a", "auth/mod", "q", ""])) for i in range(400)]

    def best(row):
        _, s, p, a, f = row
        fit = [x for x in rules if x[3] in (None, s) and x[4] in (None, p) and (x[5] is None or (a is not None and a.upper().startswith(x[5].upper()))) and (x[6] is None or (f is not None and x[6].lower() in f.lower()))]
        return max(fit, key=lambda x: (x[2], -x[0]))[1] if fit else None

    for some_rules in (rules, [x for x in rules if x[3] and x[4]]):
        rules = some_rules
        got = classify.assign_owners(spark.createDataFrame(rows, ASSET), spark.createDataFrame(rules, RULE))
        assert {x.seq: x.owner for x in got.collect()} == {x[0]: best(x) for x in rows}
        assert "NestedLoop" not in _plan(got) and "Cartesian" not in _plan(got)
    assert classify.assign_owners(spark.createDataFrame(rows, ASSET), spark.createDataFrame([], RULE)).filter("owner IS NOT NULL").count() == 0

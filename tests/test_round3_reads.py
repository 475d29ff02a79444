"""Merging with blanks, ranged pages, the XML document, re-export of a stored scan and the stream's state."""

from __future__ import annotations

import json
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from cipherledger.operators import classify, inventory, pages, reads, risk
from cipherledger.sources import tables
from cipherledger.streaming import fold

KIND = "seq long, algorithm string, purpose string, file_path string, line_number int, confidence double, owner string, priority string, urgency_flag boolean"


def records(n: int, keys: int, seed: int = 5) -> list[tuple]:
    r = random.Random(seed)
    return [(i, r.choice(("rsa", "RSA")), "mac", f"f{min(r.randrange(keys), r.randrange(keys))}", r.choice((None, 1)), r.choice((None, 0.1, 0.4, 0.4, 0.7, 0.9)), r.choice((None, f"o{i}")), (p := r.choice((None, "P1", "P2"))), r.choice((None, True)) if p else True) for i in range(n)]


def folded(rows: list[tuple]) -> dict:
    """The merge as stated: one record after the other in order of seq."""
    held: dict = {}
    for row in sorted(rows):
        key = (row[1].upper(), row[2], row[3], row[4])
        old = held.get(key)
        if old is None:
            held[key] = row
        elif (-1.0 if row[5] is None else row[5]) > (-1.0 if old[5] is None else old[5]):
            held[key] = (*row[:6], row[6] if row[6] is not None else old[6], *(row[7:] if row[7] is not None else old[7:]))
    return held


def named(df) -> dict:
    return {(r.algorithm.upper(), r.purpose, r.file_path, r.line_number): tuple(r[c.split()[0]] for c in KIND.split(", ")) for r in df.collect()}


def blank_risk(rows: dict) -> dict:
    """Without a priority there is no risk at all."""
    return {k: (*v[:8], v[8] if v[7] is not None else None) for k, v in rows.items()}


def test_winners_equal_the_fold(spark):
    rows = records(600, 12)
    df = spark.createDataFrame(rows, KIND)
    out = inventory.winners(inventory.levels(df))
    assert named(out) == blank_risk(folded(rows))
    plain = inventory.deduplicate(df).select("dedup_key", "seq", "n_observed", "first_seq")
    assert sorted(map(tuple, out.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert inventory.winners(inventory.levels(df.filter("false"))).count() == 0
    bare = inventory.winners(inventory.levels(df.drop("owner", "priority")))
    assert bare.count() == len(folded(rows)) and bare.columns == ["dedup_key", *df.drop("owner", "priority").columns, "n_observed", "first_seq"]


def test_levels_merge_in_any_order(spark):
    df = spark.createDataFrame(records(300, 5, 9), KIND)
    part = [inventory.levels(df.filter(F.col("seq") % 3 == k)) for k in range(3)]
    want = sorted(map(str, inventory.winners(inventory.levels(df)).collect()))
    for a, b, c in ((0, 1, 2), (2, 0, 1)):
        assert sorted(map(str, inventory.winners(inventory.merge_levels(inventory.merge_levels(part[a], part[b]), part[c])).collect())) == want


def test_stream_fills_blanks_and_expires(spark, tmp_path):
    rows = records(120, 4, 3)
    df = spark.createDataFrame(rows, KIND)
    for k in range(4):
        df.filter(F.col("seq") % 4 == (3 - k)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    go = lambda: fold.run(spark, f"{tmp_path}/in", df.schema, f"{tmp_path}/out", f"{tmp_path}/check")
    go()
    assert named(fold.inventory(spark, f"{tmp_path}/out")) == blank_risk(folded(rows))
    with pytest.raises(ValueError):
        fold.expire(spark, f"{tmp_path}/out", 1)
    gone = fold.expire(spark, f"{tmp_path}/out")
    assert gone and not any((tmp_path / "out" / "data" / f"v={v}").exists() for v in gone)
    assert len([p for p in (tmp_path / "out" / "manifest").iterdir() if p.name.startswith("v=")]) == 2
    assert named(fold.inventory(spark, f"{tmp_path}/out")) == blank_risk(folded(rows))
    more = [(1000 + i, *r[1:]) for i, r in enumerate(records(40, 4, 8))]
    spark.createDataFrame(more, KIND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    go()
    assert named(fold.inventory(spark, f"{tmp_path}/out")) == blank_risk(folded(rows + more))


def test_pages_in_ranges(spark, tmp_path):
    r = random.Random(2)
    data = [(i, r.choice((None, "P1", "P1", "P1", "P2")), r.choice(("a", "b"))) for i in range(3000)]
    df = spark.createDataFrame(data, "seq long, priority string, range string").repartition(7)
    order = (F.col("priority"), F.col("seq"))
    x = pages.write_ranges(df, order, f"{tmp_path}/t", 200)
    want = sorted(data, key=lambda t: (t[1] is not None, t[1] or "", t[0]))
    assert x.total == 3000 and len(x.starts) > 8 and max(n for _, _, n in x.starts) < 1000
    for limit, offset in ((1, 0), (500, 0), (37, 1234), (500, 2800), (5, 2999), (5, 3000), (5, 10**7)):
        assert [tuple(row) for row in x.page(limit, offset).collect()] == want[offset : offset + limit]
    plan = x.page(5, 2990)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    again = pages.open_ranges(spark, order, f"{tmp_path}/t")
    assert again.starts == x.starts
    none = pages.write_ranges(df.filter("false"), order, f"{tmp_path}/empty")
    assert none.total == 0 and none.page().count() == 0
    with pytest.raises(ValueError):
        x.page(501)
    with pytest.raises(ValueError):
        pages.write_ranges(df.withColumn("_range", F.lit(1)), order, f"{tmp_path}/taken")


ROWS = [(i, a, p, s, f"src/f{i}.py", i, 0.9, "R-1", "x", "deterministic") for i, (a, p, s) in enumerate([("RSA-2048", "digital_signature", "source_code"), ("MD5", "hashing", "source_code"), ("RSA & <b>\u0001", "key_establishment", "certificate"), ("AES-128", "encryption", "binary")])]


def stored(spark, tmp_path, targets=None):
    a = spark.createDataFrame(ROWS, "seq long, algorithm string, purpose string, source_surface string, file_path string, line_number int, confidence double, rule_id string, snippet string, finding_type string")
    a = risk.migration(risk.recommend(risk.score(classify.classify(inventory.deduplicate(a)))))
    a = a.withColumn("scan_id", F.when(F.col("seq") == 3, "other").otherwise("s & 1")).withColumn("depends_on", F.when(F.col("seq") == 0, F.expr("array(1L, 2L, 3L)")))
    tables.write_assets(a, f"{tmp_path}/assets")
    return tables.read_assets(spark, f"{tmp_path}/assets")


def test_reexport_of_a_stored_scan(spark, tmp_path):
    table = stored(spark, tmp_path)
    text = {}
    for fmt in ("json", "xml"):
        lines, bill = reads.reexport(table, "s & 1", "t", fmt)
        tables.write_document(lines, f"{tmp_path}/{fmt}")
        text[fmt] = "\n".join(p.read_text() for p in sorted((tmp_path / fmt).glob("part-*")))
        row = bill.first()
        assert (row.scan_id, row.format, row.component_count, row.evidence) == ("s & 1", fmt, 3, 1.0)
    doc, bom = json.loads(text["json"]), ET.fromstring(text["xml"])
    assert [bom.find("metadata/scan").text, bom.find("specVersion").text] == [doc["metadata"]["scan"], doc["specVersion"]]
    clean = lambda x: x.replace("\u0001", "�")
    parts = bom.findall("components/component")
    assert len(parts) == len(doc["components"]) == 3
    for e, c in zip(parts, doc["components"], strict=True):
        assert {k: e.find(k).text for k in c if isinstance(c[k], str)} == {k: clean(v) for k, v in c.items() if isinstance(v, str)}
        assert [(p.find("name").text, p.find("value").text) for p in e.findall("properties")] == [(p["name"], clean(p["value"])) for p in c["properties"]]
    assert [(d.find("ref").text, [t.text for t in d.findall("dependsOn")]) for d in bom.findall("dependencies/dependency")] == [(d["ref"], d["dependsOn"]) for d in doc["dependencies"]] == [("0", ["1", "2"])]
    lines, bill = reads.reexport(table, "no such scan", "t", "xml")
    assert bill.first().component_count == 0 and lines.count() == 3
    assert "PartitionFilters: [isnotnull(scan_id" in reads.reexport(table, "other", "t")[0]._jdf.queryExecution().executedPlan().toString()

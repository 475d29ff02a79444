"""Documents, inventories and graphs of many parts."""

from __future__ import annotations

import glob
import os

from pyspark.sql import functions as F

from cipherledger.operators import detect, inventory, lexer, reach, reads, risk
from cipherledger.sources import tables


def test_xml_document_of_many_files_reads_back_whole(spark, tmp_path):
    x = spark.range(200).select("id", F.concat(F.lit("</component> & <component>\n"), F.col("id").cast("string")).alias("name"))
    parts = x.select(F.col("id").alias("seq"), F.struct(F.col("id").cast("string").alias("bomRef"), "name").alias("component"))
    none = spark.createDataFrame([], "from_id long, depends_on array<long>")
    path = str(tmp_path / "document")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_document(reads.document_xml(parts, none, "s", "t"), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([f for f in glob.glob(f"{path}/part-*") if os.path.getsize(f)]) > 1
    got = tables.read_components(spark, path, "bomRef long, name string").collect()
    assert sorted((r.bomRef, r.name) for r in got) == [(i, f"</component> & <component>\n{i}") for i in range(200)]


def test_xml_components_are_written_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "XML_ROWS", 40)
    x = spark.range(0, 200, 1, 1).select(F.struct("id").alias("component"))
    tables.write_documents(x, f"{tmp_path}/xml", "xml")
    assert len(glob.glob(f"{tmp_path}/xml/part-*")) == 5
    got = spark.read.schema("id long").option("rowTag", "component").format("xml").load(f"{tmp_path}/xml")
    assert sorted(r.id for r in got.collect()) == list(range(200))


def test_scans_are_written_compact_and_without_a_sort(spark, tmp_path):
    x = spark.range(0, 300, 1, 1).select(F.col("id").alias("seq"), F.concat(F.lit("s"), (F.col("id") % 20).cast("string")).alias("scan_id"), F.lit("RSA").alias("algorithm"))
    path, key = f"{tmp_path}/assets", "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    tables.write_assets(x, path)  # more scans than OPEN_SCANS
    tables.write_assets(x.filter("scan_id = 's3' AND seq < 100"), path)
    assert spark.conf.get(key) == before
    files = glob.glob(f"{path}/scan_id=*/part-*")
    assert len(files) == 20 and all(f.endswith(".zstd.parquet") for f in files)
    got = tables.read_assets(spark, path)
    assert sorted((r.scan_id, r.seq) for r in got.collect()) == sorted((f"s{i % 20}", i) for i in range(300) if i % 20 != 3 or i < 100)


def test_statements_serve_discovery_and_the_call_graph(spark):
    code = spark.createDataFrame([("a.py", 1, "def main(x):"), ("a.py", 2, "    h = hashlib.md5(x)"), ("a.py", 3, "    f.g.run(x, y(1))")], "file_path string, line_no int, line string")
    read = reach.read_once(code)
    assert reach.read_once(read) is read and lexer.lexed(read) is read
    sites = {(r.line_no, r.pos, r.module, r.function, tuple(r.args)) for r in detect.call_sites(read).collect()}
    assert sites == {(2, 0, "hashlib", "md5", ("x",)), (3, 0, "f.g", "run", ("x", "y(1)")), (3, 1, None, "y", ("1",))}


def test_rule_lookups_are_searched_and_not_branched(spark):
    x = spark.createDataFrame([("rsa-2048", "key_establishment"), (None, None)], "algorithm string, purpose string")
    told = x.select(risk.mapping_ord().alias("m"), risk.y_years().alias("y"), risk.impact_ord().alias("i"))
    assert "CASE WHEN" not in told._jdf.queryExecution().analyzed().toString()
    assert [r.i is not None and r.y is not None for r in told.collect()] == [True, True]


def test_levels_deal_rows_out_before_they_sort_them(spark):
    x = spark.createDataFrame([(1, "RSA", "mac", "f", 1, 0.5)], "seq long, algorithm string, purpose string, file_path string, line_number int, confidence double")
    assert "RepartitionByExpression [seq" in inventory.levels(x)._jdf.queryExecution().analyzed().toString()

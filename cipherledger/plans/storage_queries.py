"""Queries whose rows go through stored tables, files or a stream and are read back, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators.reach import scratch
from ..sources import tables as T
from ..streaming import fold
from .fixtures import ctes, load
from .queries import _KEY, ORACLES, QUERIES, _with, findings, query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


_FOLDED = [
    *ctes("findings"),
    "ow AS (SELECT *, CASE WHEN seq % 3 = 0 THEN concat('o', seq % 7) END AS owner FROM findings)",
    f"ob AS (SELECT *, max(confidence) OVER ({_KEY} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ow)",
]


@query(
    _with(
        _FOLDED,
        "SELECT arg_min(algorithm, (-confidence, seq)) AS algorithm, purpose, file_path, line_number, max(confidence) AS confidence, arg_max(owner, seq) FILTER (owner IS NOT NULL AND (m IS NULL OR confidence > m)) AS owner, count(*) AS n_observed FROM ob GROUP BY upper(algorithm), purpose, file_path, line_number",
    )
)
def n01_stream(spark: SparkSession, d: str) -> DataFrame:
    """All findings arrive in six files, two a batch; the inventory after the last batch, owners handed on by displaced records."""
    x = findings(spark, d).withColumn("owner", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("o"), (F.col("seq") % 7).cast("string"))))
    source, target, checkpoint = (_folder(spark, n) for n in ("arrivals", "inventory", "progress"))
    x.repartition(6, "seq").write.parquet(source)
    fold.run(spark, source, x.schema, target, checkpoint, files_per_batch=2)
    return fold.inventory(spark, target).select("algorithm", "purpose", "file_path", "line_number", "confidence", "owner", "n_observed")


@query(_with(ctes("observed"), "SELECT scan_id, seq, algorithm, purpose, confidence FROM observed WHERE scan_id <> 'scan1' OR line_number < 25"))
def a16_stored_assets(spark: SparkSession, d: str) -> DataFrame:
    """Three scans are stored, then one of them again with fewer rows, which replace its former ones alone."""
    x, path = load(spark, d, "observed"), _folder(spark, "assets")
    T.write_assets(x, path)
    T.write_assets(x.filter("scan_id = 'scan1' AND line_number < 25"), path)
    of = lambda c: F.get_json_object("asset_json", f"$.{c}").alias(c)
    return T.read_assets(spark, path).select("scan_id", "seq", of("algorithm"), of("purpose"), "confidence")


@query(_with(ctes("observed"), "SELECT scan_id, seq, algorithm, purpose FROM observed WHERE scan_id <> 'scan2' OR line_number >= 40"))
def a17_stored_roadmaps(spark: SparkSession, d: str) -> DataFrame:
    """Roadmap rows of three scans are stored, and one scan's replaced."""
    x, path = load(spark, d, "observed"), _folder(spark, "roadmaps")
    rows = x.select("scan_id", "seq", "algorithm", "purpose")
    T.write_roadmaps(rows, path)
    T.write_roadmaps(rows.filter(x.line_number >= 40).filter("scan_id = 'scan2'"), path)
    got = spark.read.parquet(path)
    return got.select("scan_id", "seq", *[F.get_json_object("roadmap_json", f"$.{c}").alias(c) for c in ("algorithm", "purpose")])


@query(_with(ctes("observed"), "SELECT seq, algorithm, file_path, line_number FROM observed"))
def a18_component_rows(spark: SparkSession, d: str) -> DataFrame:
    """Components written as XML, a row each, and read back."""
    x, path = load(spark, d, "observed"), _folder(spark, "components")
    cols = ("seq", "algorithm", "file_path", "line_number")
    T.write_documents(x.select(F.struct(*cols).alias("component")), path, "xml")
    return spark.read.format("xml").option("rowTag", "component").schema(x.select(*cols).schema).load(path)


@query(_with([f"rep AS ({ORACLES['m11_report']})"], "SELECT CAST(row_number() OVER (ORDER BY line_no) AS BIGINT) AS place, line FROM rep"))
def a19_report_file(spark: SparkSession, d: str) -> DataFrame:
    """The report as a file: its lines in the order of the file."""
    path = _folder(spark, "report")
    T.write_report(QUERIES["m11_report"](spark, d), path)
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n", -1)).alias("_i", "line")).select((F.col("_i") + 1).cast("long").alias("place"), "line")


@query("SELECT CAST(page_id AS VARCHAR) AS file_path, CAST(pos - 1 AS INT) AS pos, s FROM (SELECT page_id, unnest(x) AS s, generate_subscripts(x, 1) AS pos FROM (SELECT page_id, list_slice(regexp_extract_all(html, '([ -~]{6,})', 1), 1, 20000) AS x FROM pages))")
def b13_printable_runs(spark: SparkSession, d: str) -> DataFrame:
    """Printable runs of the pages' bytes."""
    pages = load(spark, d, "pages")
    return X.ascii_runs(pages.select(F.col("page_id").cast("string").alias("file_path"), F.col("html").cast("binary").alias("content")))

"""Sources and sinks: file listings, and partitioned tables, documents and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import rules as R

CERTIFICATE_TYPES = (".pem", ".crt", ".cer", ".der")
#: Components of an XML file, which one task reads whole.
XML_ROWS = 50_000
#: Scans that a task writes at a time without sorting its rows.
OPEN_SCANS = 8
EXCLUDED = ("node_modules", ".git", "__pycache__", "venv", ".venv", "dist", "build")


def language_of(path):  # noqa: ANN001, ANN201
    ext = F.lower(F.regexp_extract(path, r"(\.[A-Za-z]+)$", 1))
    out = F.lit(None).cast("string")
    for e, lang in R.LANGUAGES:
        out = F.when(ext == e, lang).otherwise(out)
    return out


def list_sources(spark: SparkSession, root: str, max_bytes: int = 5_000_000) -> DataFrame:
    """(path, language, length) of source files below root; excluded folders and larger files are left out before content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", language_of(F.col("path")).alias("language"))
    return files.filter(F.col("language").isNotNull() & (F.col("length") <= max_bytes) & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in EXCLUDED])))


def listing_counts(spark: SparkSession, root: str, max_bytes: int = 5_000_000) -> DataFrame:
    """One row: files scanned, files skipped (another kind, too large or in an excluded folder) and lines of the scanned ones."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).agg(F.count("*").alias("_all"))
    kept = list_sources(spark, root, max_bytes).agg(F.count("*").alias("scanned"))
    lines = read_lines(spark, root, max_bytes).agg(F.count("*").alias("lines"))
    return every.crossJoin(kept).crossJoin(lines).select("scanned", (F.col("_all") - F.col("scanned")).alias("skipped"), "lines")


def read_lines(spark: SparkSession, root: str, max_bytes: int = 5_000_000) -> DataFrame:
    """(file_path, line_no, line) of the source files below root, lines from 1; a file is read once and cut where it lies.

    Bytes that aren't UTF-8 read as U+FFFD, so one such file doesn't stop the rest; read_problems() names it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter((F.col("length") <= max_bytes) & language_of(F.col("path")).isNotNull())
    files = files.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in EXCLUDED])))
    text = F.split(F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), r"\n$", ""), r"\r?\n", -1)
    return files.select(F.col("path").alias("file_path"), F.posexplode(text).alias("_i", "line")).select("file_path", (F.col("_i") + 1).alias("line_no"), "line")


def read_problems(spark: SparkSession, root: str, max_bytes: int = 5_000_000) -> DataFrame:
    """(file_path, reason) of source files below root that aren't read, or not as they are: larger than the limit, or not UTF-8. Only files within the limit are opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(language_of(F.col("path")).isNotNull())
    files = files.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in EXCLUDED])))
    large = files.filter(F.col("length") > max_bytes).select("path", F.lit("too large").alias("reason"))
    read = files.filter(F.col("length") <= max_bytes)
    bad = read.select("path", F.when(~F.is_valid_utf8(F.col("content").cast("string")), "not UTF-8").alias("reason")).filter("reason IS NOT NULL")
    return large.unionByName(bad).withColumnRenamed("path", "file_path")


def list_certificates(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of certificate files below root by extension, without excluded folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    ext = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    return files.filter(ext.isin(*CERTIFICATE_TYPES) & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in EXCLUDED]))).select("path", "length", "content")


def list_binaries(spark: SparkSession, root: str, max_bytes: int = 200_000_000) -> DataFrame:
    """(path, kind, content) of executables: by first bytes, else by extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter((F.col("length") > 0) & (F.col("length") <= max_bytes))
    head = F.hex(F.substring("content", 1, 4))
    kind = F.when(head == "7F454C46", "elf").when(head.startswith("4D5A"), "pe").when(F.lower("path").rlike(r"\.(so|dll|exe|dylib|a|o)$"), "binary")
    return files.withColumn("kind", kind).filter("kind IS NOT NULL").select("path", "kind", "content")


def _replace_scans(rows: DataFrame, path: str) -> None:
    """Writes the rows in place of all that their scans hold; a task keeps a file open for each of OPEN_SCANS scans, and sorts its rows only where it has more."""
    conf = rows.sparkSession.conf
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, str(OPEN_SCANS))
    try:
        rows.write.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("scan_id").mode("overwrite").parquet(path)
    finally:
        conf.set(key, before)


def write_assets(assets: DataFrame, path: str) -> None:
    """Replaces all rows of the scans in `assets`: flat columns beside one JSON column, partitioned by scan."""
    out = assets.withColumn("asset_json", F.to_json(F.struct(*[c for c in assets.columns if c != "scan_id"])))
    _replace_scans(out, path)


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """The table that write_assets() keeps; a filter on scan_id reads that scan's partition alone."""
    return spark.read.option("mergeSchema", True).parquet(path)


def write_documents(components: DataFrame, path: str, fmt: str = "json") -> None:
    """Bill-of-materials components, a JSON or XML row each, so that no document passes through one task; write_document() writes one document."""
    if fmt == "json":
        components.select(F.to_json("component").alias("value")).write.text(path)
    else:
        components.select("component.*").write.format("xml").option("rowTag", "component").option("maxRecordsPerFile", XML_ROWS).save(path)


def write_roadmaps(roadmaps: DataFrame, path: str) -> None:
    """Replaces the roadmaps of the scans in `roadmaps`: (scan_id, seq, roadmap_json), partitioned by scan."""
    out = roadmaps.select("scan_id", "seq", F.to_json(F.struct(*[c for c in roadmaps.columns if c not in ("scan_id", "seq")])).alias("roadmap_json"))
    _replace_scans(out, path)


def write_document(lines: DataFrame, path: str) -> None:
    """One bill of materials, its ordered lines range-partitioned so that the files in order are the document."""
    lines.repartitionByRange("section", "ord").sortWithinPartitions("section", "ord").select(F.col("line").alias("value")).write.text(path)


def read_components(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Components of an XML document that write_document() keeps, with the columns of schema.

    Its files are one document only in order: those after the first have no head, so an XML reader ends at the first
    element of each. Files are cut at the end tag of a component instead, which no escaped text holds, and may be split anywhere.
    """
    rows = spark.read.text(path, lineSep="</component>").filter(F.contains("value", F.lit("<component>")))
    element = F.concat(F.regexp_extract("value", r"(?s)(<component>.*)", 1), F.lit("</component>"))
    return rows.select(F.from_xml(element, schema, {"rowTag": "component"}).alias("c")).select("c.*")


def write_report(lines: DataFrame, path: str) -> None:
    lines.orderBy("line_no").select(F.col("line").alias("value")).coalesce(1).write.text(path)  # a report has a fixed number of lines

"""Findings that arrive in files, folded into the inventory by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inventory import dedup_key, levels, merge_levels, winners

#: Parts of the inventory by key; a batch rewrites those that it touches.
BUCKETS = 64


def merge(current: DataFrame | None, batch: DataFrame) -> DataFrame:
    """State after a batch: the first record of each key at each confidence over kept rows and new findings, with counts added up."""
    new = levels(batch)
    return new if current is None else merge_levels(current, new)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("dedup_key"), F.lit(BUCKETS)).cast("int")


def _versions(spark: SparkSession, target: str, k: int) -> dict[int, int]:
    """The version that holds each bucket after batch k; at most BUCKETS rows."""
    return {} if k < 0 else {r["bucket"]: r["version"] for r in spark.read.parquet(f"{target}/manifest/v={k}").collect()}


def _files(spark: SparkSession, target: str, held: dict[int, int]) -> DataFrame | None:
    paths = [f"{target}/data/v={v}/bucket={b}" for b, v in sorted(held.items())]
    return spark.read.parquet(*paths) if paths else None


def inventory(spark: SparkSession, target: str) -> DataFrame:
    """The inventory after the last batch, blanks filled from displaced records."""
    last = spark.read.parquet(f"{target}/manifest").agg(F.max("v")).first()[0]
    found = _files(spark, target, _versions(spark, target, last))
    if found is None:
        raise ValueError("no finding has arrived yet")
    return winners(found)


def expire(spark: SparkSession, target: str, keep: int = 2) -> list[int]:
    """Deletes the versions that none of the last `keep` manifests names, and the manifests before them; gives the versions gone.

    A batch that is repeated builds on the manifest before its own, so keep is 2 at least; a reader of the inventory needs
    no more than the last one. Run it between batches: the manifests' rows are at most keep * BUCKETS.
    """
    if keep < 2:
        raise ValueError("keep must be 2 or more")
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(target)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = lambda kind: sorted(int(x.getPath().getName()[2:]) for x in fs.listStatus(jvm.Path(root, kind)) if x.getPath().getName().startswith("v="))
    manifests = listed("manifest")
    held = {v for k in manifests[-keep:] for v in _versions(spark, target, k).values()}
    last = manifests[-1] if manifests else -1
    gone = [v for v in listed("data") if v not in held and v <= last]
    for v in gone:
        fs.delete(jvm.Path(root, f"data/v={v}"), True)
    for k in manifests[:-keep]:
        fs.delete(jvm.Path(root, f"manifest/v={k}"), True)
    return gone


def run(spark: SparkSession, source: str, schema, target: str, checkpoint: str, files_per_batch: int = 1) -> None:  # noqa: ANN001
    """Processes the files there are.

    Batch k reads and writes only the buckets of its own keys, as version k; a manifest per batch names the version of
    each bucket. It builds on the manifest of batch k - 1 alone, so a repeated batch gives the same table.
    """

    def fold(batch: DataFrame, k: int) -> None:
        held = _versions(spark, target, k - 1)
        keys = batch.select(dedup_key().alias("dedup_key")).select(_bucket().alias("b")).distinct().collect()
        touched = {r["b"] for r in keys}  # at most BUCKETS
        before = _files(spark, target, {b: v for b, v in held.items() if b in touched})
        merge(before, batch).withColumn("bucket", _bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/v={k}")
        now = sorted((held | dict.fromkeys(touched, k)).items())
        spark.createDataFrame(now, "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{target}/manifest/v={k}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

"""Pages at any depth: rows are written once in ranges of their order and counted, so that a page reads the ranges that hold it."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Column that names a row's range in the written table.
RANGE = "_range"


@dataclass(frozen=True)
class Ranges:
    """A table in ranges: where it lies, its order, and (range, rows before it, rows) of each range that has rows."""

    spark: SparkSession
    path: str
    order: tuple[Column, ...]
    starts: tuple[tuple[int, int, int], ...]
    schema: StructType

    @property
    def total(self) -> int:
        """Rows in all, from the counts alone."""
        return self.starts[-1][1] + self.starts[-1][2] if self.starts else 0

    def page(self, limit: int = 50, offset: int = 0) -> DataFrame:
        """Rows offset to offset + limit of the order, in order. Only their ranges are read and sorted; past the end there are none."""
        _checked(limit, offset)
        held = [(r, before) for r, before, n in self.starts if before < offset + limit and before + n > offset]
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        part = rows.filter(F.col(RANGE).isin([r for r, _ in held])) if held else rows.filter("false")
        return part.drop(RANGE).orderBy(*self.order).offset(offset - held[0][1] if held else 0).limit(limit)


def _checked(limit: int, offset: int) -> None:
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset 0 or more")


def write_ranges(rows: DataFrame, order: tuple[Column, ...], path: str, per_range: int = 1_000_000) -> Ranges:
    """Writes `rows` in ranges of `order`, about per_range rows each, and their counts below `path`; the order must end in a unique column.

    Rows are counted once for the number of ranges, then shuffled once. Equal keys stay in one range: a value that a third
    of all rows have is split by the columns behind it. Nulls come first. An empty table has no range and only empty pages.
    """
    if RANGE in rows.columns:
        raise ValueError(f"the column name {RANGE} is taken")
    n = max(1, -(-rows.count() // per_range))
    cut = rows.repartitionByRange(n, *order).withColumn(RANGE, F.spark_partition_id())
    schema = cut.schema
    cut.write.partitionBy(RANGE).parquet(f"{path}/rows")
    written = rows.sparkSession.read.schema(schema).parquet(f"{path}/rows")
    counts = written.groupBy(RANGE).agg(F.count("*").alias("n"))
    none = rows.sparkSession.createDataFrame([(-1, 0)], counts.schema)  # keeps the schema of an empty table
    counts.unionByName(none).withColumn("schema", F.lit(schema.json())).coalesce(1).write.parquet(f"{path}/counts")
    return open_ranges(rows.sparkSession, order, path)


def open_ranges(spark: SparkSession, order: tuple[Column, ...], path: str) -> Ranges:
    """A table that write_ranges() wrote; a number for each range comes to the driver."""
    counts = spark.read.parquet(f"{path}/counts").orderBy(RANGE).collect()
    starts, before = [], 0
    for r in counts:
        if r["n"]:
            starts.append((r[RANGE], before, r["n"]))
            before += r["n"]
    return Ranges(spark, path, order, tuple(starts), StructType.fromJson(json.loads(counts[0]["schema"])))

"""Associative scans along a file: what holds before each line, with the lines of one file in many tasks.

A line acts on a state (the open literal, the bracket depth, the open definitions); actions compose to actions of the
same kind. Actions of a block of lines are composed in one row, those of a file's blocks meet in one row of the file, and
the states go back to the blocks. So no task holds more lines than a block, and a file with a third of all lines spreads;
its row holds an action for each thousand lines. Lines are shuffled once, by file and block; other than that actions move.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines of a block.
BLOCK = 1024


def _folded(steps: Column, compose: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.slice(steps, F.lit(2), F.size(steps)), F.get(steps, F.lit(0)), compose)


def _states(items: Column, start: Column, kind: str, apply: Callable[[Column, Column], Column]) -> Column:
    """The state before each item."""
    zero = F.struct(start.cast(kind).alias("s"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(items, zero, lambda a, x: F.struct(apply(a["s"], x["step"]).cast(kind).alias("s"), F.array_append(a["out"], a["s"]).alias("out")))["out"]


def block_scan(rows: DataFrame, name: str, step: Column, start: Column, kind: str, apply: Callable[[Column, Column], Column], compose: Callable[[Column, Column], Column], key: str = "file_path", order: str = "line_no") -> DataFrame:
    """rows with the column `name` of type `kind`: the state before each row, in order within its key, from `start` on.

    step: a row's action; apply(state, action); compose(first, second). Rows that share key and order come in the order
    of their other columns. A column `_block` stays on the rows, so that a further scan needs no shuffle of them.
    """
    columns = [c for c in rows.columns if c != "_block"]
    x = rows if "_block" in rows.columns else rows.withColumn("_block", F.floor(F.col(order) / BLOCK))
    item = F.struct(F.col(order).alias("o"), F.struct(*columns).alias("row"), step.alias("step"))
    blocks = x.groupBy(key, "_block").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    folded = F.struct(F.col("_block").alias("o"), _folded(F.col("_items.step"), compose).alias("step"))
    files = blocks.select(key, folded.alias("i")).groupBy(key).agg(F.array_sort(F.collect_list("i")).alias("_i"))
    firsts = files.select(key, F.inline(F.arrays_zip(F.col("_i.o").alias("_block"), _states(F.col("_i"), start, kind, apply).alias("_first"))))
    # States of the blocks are hashed, a partition of them at a time: left alone, Spark would send whole tables of lines to the driver.
    out = blocks.join(firsts.hint("shuffle_hash"), [key, "_block"])
    out = out.select(key, "_block", F.explode(F.arrays_zip(F.col("_items.row").alias("row"), _states(F.col("_items"), F.col("_first"), kind, apply).alias("state"))).alias("x"))
    return out.select(*[F.col(c) if c == key else F.col(f"x.row.{c}").alias(c) for c in columns], "_block", F.col("x.state").alias(name))

"""Corpus pipeline: quality rules, near duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.

All stages alike: a null text counts as empty; a null lang or source stays null; texts of any length are read whole; an
empty table gives an empty one; columns beyond those of `documents` aren't read, whatever their names. Repeated rows
are judged each on their own by stages 1 and 5; to the others, rows that share an id are one document and stay or go
together. A null id stays with its row; the byte stage treats it as the least id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.llm import byte_dedup, jaccard_join, line_rules, mixing, piece_encoding
from cipherledger.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame, text: str) -> DataFrame:
    return df.select("doc_id", F.col(text).alias("text"), "carried.lang", "carried.source", F.length(text).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go; documents that fail the base rule or lose half of their words go."""
    return _documents(line_rules.line_quality(docs, carry=("lang", "source")).filter("kept"), "clean_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked ones stays (all its rows, if the id repeats); so do documents without words or id."""
    gone = jaccard_join.jaccard_components(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has go from the later texts; broken characters stay whole."""
    return _documents(byte_dedup.remove_repeats(docs, with_text=True, carry=("lang", "source")), "kept_text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares follow the targets by source, language and topic."""
    return mixing.mix_sources(docs.select(*COLUMNS)).filter("mix_selected").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text left, with digests of ids and decoded text."""
    out = piece_encoding.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated passages", repeated_passages), ("mixing", mix), ("encoding", encode)]
#: Byte removal and piece encoding have no SQL; tests/llm/test_pipeline.py compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage{k}")
    return docs

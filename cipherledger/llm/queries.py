"""Queries op1 to op13 over whole tables, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_dedup, dialogue, jaccard_join, license_scan, line_rules, merkle, mixing, periodic_runs, phrase_index, piece_encoding, quality, token_files, warc
from .common import scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.encode_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_token_files(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_files.read_token_files(spark, path)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix_sources(_read(spark, sf_dir, "documents"), keep=("doc_id",)))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archive(_read(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path)


def op6_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.rotate_perspectives(_read(spark, sf_dir, "conversations"))


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_against_next(_read(spark, sf_dir, "documents"))


def op8_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup.remove_repeats(_read(spark, sf_dir, "documents"))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_quality(_read(spark, sf_dir, "documents")).drop("clean_text")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(_read(spark, sf_dir, "documents")))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_index.top_phrases(phrase_index.mine_phrases(_read(spark, sf_dir, "documents")))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs_of_documents(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_pieces, op3_token_files, op4_mixing, op5_warc, op6_perspectives, op7_merkle, op8_byte_dedup, op9_line_rules, op10_jaccard, op11_licenses, op12_phrases, op13_runs)}
ORACLES: dict[str, str] = {"op4_mixing": mixing.sql(), "op5_warc": warc.SQL, "op6_perspectives": dialogue.SQL, "op9_line_rules": line_rules.sql(), "op11_licenses": license_scan.sql(), "op12_phrases": phrase_index.sql()}

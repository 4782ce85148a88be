"""Queries of the training-data operators, with SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlog.llm import raking
from strandlog.llm.common import read_table
from strandlog.llm.compression_bands import compression_bands
from strandlog.llm.dart_minhash import near_classes
from strandlog.llm.hyperdim_lang import language_id
from strandlog.llm.imatch import imatch
from strandlog.llm.license_scan import license_scan
from strandlog.llm.quote_links import conversations_without_quotes
from strandlog.llm.suffix_dedup import repeats_digest
from strandlog.llm.toxic_lexicon import toxicity
from strandlog.llm.unigram_pieces import encoding_digest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def put(f):
        QUERIES[name] = f
        return f

    return put


@query("op1_dart_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read_table(spark, sf_dir, "documents"))


@query("op2_imatch")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch(read_table(spark, sf_dir, "documents"))


@query("op3_toxic_lexicon")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op4_quote_links")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations_without_quotes(read_table(spark, sf_dir, "conversations"))


@query("op5_compression_bands")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_bands(read_table(spark, sf_dir, "documents"))


@query("op6_raking")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mix(read_table(spark, sf_dir, "documents"))


ORACLES["op6_raking"] = raking.oracle()


@query("op7_hyperdim_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))


@query("op8_suffix_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(read_table(spark, sf_dir, "documents"))


@query("op9_unigram_pieces")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digest(read_table(spark, sf_dir, "documents"))


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

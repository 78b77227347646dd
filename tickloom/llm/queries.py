"""Queries of the text problems over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.leakage import find_leaks
from tickloom.llm.sentences import split_sentences
from tickloom.llm.tokens import encode_corpus


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(_table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(_table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p7_ids, p8_found, p9_found)}
ORACLES: dict[str, str] = {}

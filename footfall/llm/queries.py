"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import (
    conversation_repair,
    decontaminate,
    language_id,
    line_dedup,
    mixing,
    near_dedup,
    quality_model,
    quality_rules,
    ranked_search,
    secret_scan,
    substring_dedup,
    surrogates,
    token_scan,
)
from footfall.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(parts: int) -> Column:
    """crc32 of the doc_id as text, modulo ``parts``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(remainder(5) != 0), language_id.read_pieces())
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data.

    The key is taken from the session; a session without one gets a fresh key for this run.
    """
    key = spark.conf.get("spark.footfall.surrogates.key", None) or secrets.token_hex(32)
    return surrogates.digest(table(spark, sf_dir, "documents"), key)


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, by a separator scan of its flat token files."""
    return token_scan.count_tokens(table(spark, sf_dir, "documents"))


@query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by pattern and by entropy."""
    return secret_scan.digest(table(spark, sf_dir, "documents"))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes."""
    return mixing.usage(table(spark, sf_dir, "documents"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures of every document, and whether it and its host pass."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that other documents hold too."""
    return substring_dedup.repeated(table(spark, sf_dir, "documents"))


@query
def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(remainder(4) != 2)
    scored = quality_model.score(table(spark, sf_dir, "documents"), labels)
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.digest(conversation_repair.damage(conversations), conversations)


@query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, and what is left without those that many documents share."""
    return line_dedup.digest(table(spark, sf_dir, "documents"))

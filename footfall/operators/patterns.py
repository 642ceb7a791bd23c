"""Frequent place sets and sequences, and the rules they support."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SUPPORT = 0.01
SET_CONFIDENCE = 0.2
SEQUENCE_CONFIDENCE = 0.01
MAX_LENGTH = 5


def _model(baskets: DataFrame, min_support: float, min_confidence: float):
    return FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)


def itemsets_and_rules(
    baskets: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = SET_CONFIDENCE
) -> tuple[DataFrame, DataFrame]:
    """Both tables of one fit: those of :func:`frequent_itemsets` and :func:`association_rules`."""
    model = _model(baskets, min_support, min_confidence)
    sets = model.freqItemsets.select(F.sort_array("items").alias("items"), "freq")
    return sets, model.associationRules.withColumn("antecedent", F.sort_array("antecedent"))


def frequent_itemsets(baskets: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """Place sets in at least ``min_support`` of the baskets: ``items`` (sorted), ``freq``."""
    return itemsets_and_rules(baskets, min_support)[0]


def association_rules(
    baskets: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = SET_CONFIDENCE
) -> DataFrame:
    """Rules with one consequent: ``antecedent, consequent, confidence, lift, support``."""
    return itemsets_and_rules(baskets, min_support, min_confidence)[1]


def frequent_sequences(
    sequences: DataFrame, min_support: float = MIN_SUPPORT, max_length: int = MAX_LENGTH
) -> DataFrame:
    """Ordered place lists in at least ``min_support`` of the days: ``items, freq``."""
    miner = PrefixSpan(minSupport=min_support, maxPatternLength=max_length, sequenceCol="sequence")
    found = miner.findFrequentSequentialPatterns(sequences.select("sequence"))
    return found.select(F.flatten("sequence").alias("items"), "freq")


def sequence_rules(patterns: DataFrame, min_confidence: float = SEQUENCE_CONFIDENCE) -> DataFrame:
    """Rules from frequent sequences: ``antecedent, consequent, confidence``.

    Each place of a sequence in turn is the consequent and the others, in order,
    the antecedent. Confidence is the ratio of the two frequencies.
    """
    split = patterns.filter(F.size("items") > 1).select("items", "freq", F.posexplode("items").alias("at", "consequent"))
    rest = F.filter("items", lambda _, i: i != F.col("at"))
    split = split.select(rest.alias("antecedent"), F.array("consequent").alias("consequent"), "freq")
    base = patterns.select(F.col("items").alias("antecedent"), F.col("freq").alias("base"))
    rules = split.join(base, "antecedent").withColumn("confidence", F.col("freq") / F.col("base"))
    return rules.filter(F.col("confidence") >= min_confidence).select("antecedent", "consequent", "confidence")

"""Host-level quality rules.

Every document is measured by rules over its whole text. Failures are summed per
host and rule, each host's failure rate is shrunk towards the rate of all hosts
with an empirical beta prior, and a host whose shrunk rate is too high takes its
documents along. Only DataFrame functions are used, and texts are never shuffled.

Defined results: a null or blank text has no words and fails as too short; a null
host is a host of its own; repeated rows count and are judged one by one; an empty
table gives an empty table; columns other than those named are ignored here and
kept by :func:`keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.text import fenced_filter, keeping_columns, left_lookup, split_words, tagged
from footfall.session import stage

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
# A host is rejected when the shrunk failure rate of one of its rules lies above this.
MAX_HOST_RATE = 0.5
# Strength of the prior, in documents, where the hosts' rates do not vary enough to estimate it.
PRIOR_DOCUMENTS = 20.0
SYMBOLS = "[#*$%&|<>]"
RULES = ("short", "repeats", "symbols", "lines")


def _window_count(words: Column) -> Column:
    return F.size(words) - (WINDOW - 1)


def with_measures(docs: DataFrame, text: str = "text", into: str = "__m") -> DataFrame:
    """Add ``into``, a struct of the measures and of the rules that the document fails.

    Repeated windows are looked for by hash first. Only where two hashes of a text
    agree are the windows themselves sorted and compared, so equality is exact.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words, hashes, grams = F.col("__words"), F.col("__hashes"), F.col("__grams")
    at = F.sequence(F.lit(0), _window_count(words) - 1)
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    df = docs.withColumn("__words", split_words(F.col(text))).withColumn("__lines", lines)
    df = df.withColumn(
        "__hashes",
        F.when(
            _window_count(words) >= 2,
            F.transform(at, lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)])),
        ),
    )
    df = df.withColumn(
        "__grams",
        F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes),
            F.array_sort(
                F.transform(
                    at, lambda i: F.struct(F.array_join(F.slice(words, i + 1, F.lit(WINDOW)), " ").alias("g"), i.alias("i"))
                )
            ),
        ),
    )
    same = lambda k, j: F.get(grams, k)["g"] == F.get(grams, j)["g"]
    repeated = F.filter(grams, lambda x, k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    df = df.withColumn("__starts", F.array_sort(F.transform(repeated, lambda x: x["i"])))
    starts = F.col("__starts")
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    n_words = F.size(words).cast("bigint")
    measures = F.struct(
        n_words.alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size("__lines").cast("bigint").alias("n_lines"),
    )
    df = df.withColumn("__base", measures)
    base = F.col("__base")
    short = base["n_words"] < MIN_WORDS
    repeats = 100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"]
    judged = F.struct(
        "__base.*",
        short.alias("short"),
        repeats.alias("repeats"),
        (10 * base["n_symbols"] > base["n_words"]).alias("symbols"),
        (10 * base["n_dup_lines"] > 3 * base["n_lines"]).alias("lines"),
        (short | repeats).alias("base_failed"),
    )
    return df.withColumn(into, judged).drop("__words", "__lines", "__hashes", "__grams", "__starts", "__base")


def host_rates(measured: DataFrame) -> DataFrame:
    """Shrunk failure rates: ``host, rule, n, failed, rate``, from rows ``host, short, repeats, symbols, lines``.

    The prior Beta(a, b) of a rule has the mean of all documents; its strength
    a + b follows from the spread of the hosts' rates by the method of moments. Counts
    are added up before the shuffle, so a hot host costs one row per task.
    """
    counts = measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(rule).cast("bigint")).alias(rule) for rule in RULES]
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("failed")) for rule in RULES]))
    hosts = stage(counts.select("host", "n", pairs.alias("r")).select("host", "n", "r.rule", "r.failed"), "hosts")
    mean = F.sum("failed") / F.sum("n")
    spread = F.var_samp(F.col("failed") / F.col("n"))
    prior = hosts.groupBy("rule").agg(mean.alias("mean"), spread.alias("spread"))
    strength = F.when(F.col("spread") > 0, F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1)
    strength = F.when(strength > 0, strength).otherwise(PRIOR_DOCUMENTS)
    # One row per rule, and the rules are fixed.
    prior = F.broadcast(prior.select("rule", "mean", strength.alias("strength")))
    rate = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))
    return hosts.join(prior, "rule").select("host", "rule", "n", "failed", rate.alias("rate"))


def rejected_hosts(rates: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Hosts with a rule above ``max_rate``: ``host, host_rate``, the highest rate."""
    return rates.groupBy("host").agg(F.max("rate").alias("host_rate")).filter(F.col("host_rate") > max_rate)


def judge(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row of measures and verdicts per document, from ``doc_id, text, source``."""
    measured = with_measures(docs.select("doc_id", "text", tagged(F.col("source")).alias("host")))
    measured = stage(measured.select("doc_id", "host", "__m.*"), "measures")
    bad = rejected_hosts(host_rates(measured), max_rate)
    judged = left_lookup(measured, bad, ["host"], ["doc_id", "word_chars"])
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("host_rate").isNull())


@keeping_columns("doc_id", "text", "source")
def keep_good(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Texts are read twice instead of being shuffled: once for the host rates, once
    for the filter.
    """
    host = tagged(F.col("source"))
    rates = host_rates(with_measures(docs.select("text", host.alias("host"))).select("host", "__m.*"))
    bad = rejected_hosts(rates, max_rate).withColumnRenamed("host", "__host")
    passed = fenced_filter(with_measures(docs), ~F.col("__m.base_failed")).drop("__m").withColumn("__host", host)
    return left_lookup(passed, bad, ["__host"], ["doc_id", "text"]).filter(F.col("host_rate").isNull()).select(*docs.columns)

"""Column expressions over whole texts, and joins that several operators share."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.operators.joins import BROADCAST_ROWS

# The white space and the separators that the query contracts name.
SPACES = "[\\x20\\x09-\\x0D]+"
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Non-ASCII characters that lower() would change although only A-Z may change.
OTHER_CASED = "[\\p{javaUpperCase}\\p{javaTitleCase}&&[^A-Z]]"
# Matches that one inner prefix sum covers; see match_spans.
CHUNK = 256
SALTS = 32


def split_words(text: Column, separators: str = SPACES) -> Column:
    """Words of a whole text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts without other capitals take the fast way."""
    return F.when(text.rlike(OTHER_CASED), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def tagged(column: Column) -> Column:
    """A key that is never null: null and text stay apart."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start, end, value>>`` in code points.

    The gaps between matches and the matches themselves give the positions as
    running sums: first over chunks of ``CHUNK`` matches, then within each, so the
    work stays linear in practice also for a text with very many matches.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # A match always has a character, so the text splits into one gap more than matches.
    return F.when(text.rlike(pattern), _located(F.split(text, pattern, -1), values)).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    )


def _located(gaps: Column, values: Column) -> Column:
    parts = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(values)),
        values,
        lambda gap, value: F.struct(F.length(gap).cast("bigint").alias("gap"), F.length(value).cast("bigint").alias("n"), value.alias("value")),
    )
    chunked = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")),
        lambda c: F.slice(parts, c * CHUNK + 1, F.lit(CHUNK)),
    )
    zero = F.lit(0).cast("bigint")
    ends = lambda xs: F.aggregate(xs, zero, lambda total, x: total + x["gap"] + x["n"])
    none = F.array().cast("array<bigint>")
    starts = F.aggregate(
        chunked,
        F.struct(zero.alias("at"), none.alias("out")),
        lambda acc, chunk: F.struct(
            (acc["at"] + ends(chunk)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")
        ),
        lambda acc: acc["out"],
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def locate(chunk: Column, start: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(start.alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + x["n"]).alias("at"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + x["gap"]).alias("start"),
                            (acc["at"] + x["gap"] + x["n"]).alias("end"),
                            x["value"].alias("value"),
                        )
                    ),
                ).alias("out"),
            ),
            lambda acc: acc["out"],
        )

    return F.flatten(F.zip_with(chunked, starts, locate))


def fenced_filter(df: DataFrame, condition: Column) -> DataFrame:
    """Filter by a costly condition that is computed once, in the projection below.

    The optimizer would move the filter below the projections and repeat their
    expressions inside it, nested in lambdas; it leaves a filter above a row number.
    """
    flagged = df.withColumns({"__keep": condition, "__row": F.monotonically_increasing_id()})
    return flagged.filter(F.col("__keep") & (F.col("__row") >= 0)).drop("__keep", "__row")


def left_lookup(
    big: DataFrame, small: DataFrame, keys: list[str], salt_by: list[str], broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Left join with a counted side: broadcast below the limit, salted beyond it.

    ``small`` holds each key once. Beyond the limit every key of ``big`` is spread
    over ``SALTS`` parts, and ``small`` is repeated for each part, which Spark's estimate
    of its size leaves out: the join names its method.
    """
    if small.count() <= broadcast_rows:
        return big.join(F.broadcast(small), keys, "left")
    parts = big.withColumn("__salt", F.pmod(F.xxhash64(*salt_by), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return parts.hint("merge").join(copies, [*keys, "__salt"], "left").drop("__salt")


def fresh_names(df: DataFrame, names: list[str]) -> dict[str, str]:
    """Working names that no column of ``df`` has, whatever the case."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in names:
        free = f"__{name}"
        while free.lower() in taken:
            free += "_"
        out[name] = free
    return out


def keeping_columns(*used: str):
    """Decorator of functions that return rows of ``docs`` with all their columns.

    Columns that the function does not use get names of their own while it runs, so none
    can clash with its working columns.
    """

    def decorate(function):
        @wraps(function)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            inside = [c.lower() if c.lower() in used else f"carried_{k}" for k, c in enumerate(docs.columns)]
            return function(docs.toDF(*inside), *args, **options).toDF(*docs.columns)

        return run

    return decorate

"""Equi-joins that keep their balance when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.session import stage

# A side is broadcast only when it was counted and stays below this many rows.
BROADCAST_ROWS = 200_000
# No task should have to hold more rows of one key than this.
HOT_ROWS = 1_000_000

def hot_keys(df: DataFrame, keys: list[str], rows: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys of more than ``hot_rows`` rows with their count ``hot_n``, or None when there are none.

    The limit is what a task may hold of one key and does not depend on the size of
    ``df``. The counts are aggregated before the shuffle.
    """
    rows = df.count() if rows is None else rows
    if rows <= hot_rows:
        return None
    hot = stage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("hot_n")).filter(F.col("hot_n") > hot_rows), "hot")
    return None if hot.isEmpty() else hot.withColumn("salts", F.ceil(F.col("hot_n") / hot_rows))


def counted(small: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if it was counted and is below the limit."""
    return F.broadcast(small) if small.count() <= broadcast_rows else small


def salted_join(
    split: DataFrame,
    copied: DataFrame,
    keys: list[str],
    salt_by: list[str],
    rows: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join in which the hot keys of ``split`` are spread over many tasks.

    Rows of a hot key are split by a hash of ``salt_by``; the matching rows of
    ``copied`` are repeated once per part. Every pair meets exactly once.
    """
    hot = hot_keys(split, keys, rows, hot_rows)
    if hot is None:
        return split.join(copied, keys)
    small = counted(hot.select(*keys, "salts"))
    salt = F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*salt_by), F.col("salts")))
    parts = split.join(small, keys, "left").withColumn("salt", salt.cast("bigint")).drop("salts")
    copies = (
        copied.join(small, keys, "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)) - 1)))
        .drop("salts")
    )
    return parts.join(copies, [*keys, "salt"]).drop("salt")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    salt_by: list[str],
    small_rows: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Inner join with a side that is usually small.

    ``small`` is written once and counted: below the limit it is broadcast, so ``big``
    is not shuffled; beyond it the join is salted by the hot keys of ``big``, and no side
    is left to Spark to broadcast, which counts the rows before an explode.
    """
    if small_rows is None:
        small = stage(small, "small")
        small_rows = small.count()
    if small_rows <= broadcast_rows:
        return big.join(F.broadcast(small), keys)
    return salted_join(big.hint("merge"), small, keys, salt_by, hot_rows=hot_rows)

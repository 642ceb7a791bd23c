"""Descending curves held as histograms: running positions and elbow points.

A curve is a set of rows ``keys..., value, weight``: each distinct value once,
with the number of times it occurs. Equal values share the position of the first
of them, which is exact for every rule here, and hot values collapse before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators.joins import HOT_ROWS, counted, hot_keys
from footfall.session import stage


def histogram(df: DataFrame, keys: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """Distinct values per key with their number ``n``."""
    number = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*keys, value).agg(number.alias("n"))


def _with_blocks(hist: DataFrame, hot: DataFrame, keys: list[str], value: str, blocks: int) -> DataFrame:
    """Add ``block``: contiguous ranges of descending value, several for a hot key.

    Block limits are approximate quantiles. They steer only how the work is cut
    up, so they need not be exact; they are written down once so that every
    reader sees the same ones. A key keeps limits in proportion to its rows: about two
    for each ``hot_rows`` rows of the table, whatever the number of keys.
    """
    share = [i / blocks for i in range(1, blocks)]
    quantiles = (
        hist.join(counted(hot.select(*keys, "salts")), keys)
        .groupBy(*keys)
        .agg(F.percentile_approx(value, share, 10 * blocks).alias("quantiles"), F.first("salts").alias("salts"))
    )
    wanted = F.least(F.lit(blocks), 2 * F.col("salts"))
    at = F.transform(F.sequence(F.lit(1), wanted - 1), lambda i: F.floor(i * blocks / wanted).cast("int"))
    limits = F.transform(at, lambda i: F.element_at("quantiles", i))
    limits = stage(quantiles.select(*keys, limits.alias("limits")), "limits")
    above = F.size(F.filter("limits", lambda limit: limit > F.col(value)))
    return hist.join(counted(limits), keys, "left").withColumn(
        "block", F.when(F.col("limits").isNull(), F.lit(0)).otherwise(above)
    ).drop("limits")


def with_positions(
    hist: DataFrame,
    keys: list[str],
    value: str,
    weight: str = "n",
    rows: int | None = None,
    hot_rows: int = HOT_ROWS,
    keep_block: bool = False,
) -> DataFrame:
    """Add the index ``start`` of the first occurrence in the descending curve, the
    curve length ``total`` and its end values ``y_first`` and ``y_last``.

    One window per key while every key fits into a task. Otherwise a two-level
    prefix sum: weights are summed over the (few) blocks of a key, then within
    each block, so that no task sees more than one block. ``rows`` is an upper
    bound on the rows of ``hist`` where the caller knows one. ``keep_block`` keeps
    the number of the block, 0 throughout when there is only one.
    """
    by_key = Window.partitionBy(*keys)
    hot = hot_keys(hist, keys, rows, hot_rows)
    if hot is None:
        before = by_key.orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
        one_block = [F.lit(0).alias("block")] if keep_block else []
        return hist.select(
            "*",
            *one_block,
            F.coalesce(F.sum(weight).over(before), F.lit(0)).alias("start"),
            F.sum(weight).over(by_key).alias("total"),
            F.max(value).over(by_key).alias("y_first"),
            F.min(value).over(by_key).alias("y_last"),
        )
    largest = hot.agg(F.max("salts")).first()[0]
    blocked = _with_blocks(hist, hot, keys, value, 2 * largest)
    per_block = blocked.groupBy(*keys, "block").agg(
        F.sum(weight).alias("block_n"), F.max(value).alias("block_max"), F.min(value).alias("block_min")
    )
    before = by_key.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        *keys,
        "block",
        F.coalesce(F.sum("block_n").over(before), F.lit(0)).alias("offset"),
        F.sum("block_n").over(by_key).alias("total"),
        F.max("block_max").over(by_key).alias("y_first"),
        F.min("block_min").over(by_key).alias("y_last"),
    )
    within = Window.partitionBy(*keys, "block").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumn("local", F.coalesce(F.sum(weight).over(within), F.lit(0)))
    return (
        local.join(offsets, [*keys, "block"])
        .withColumn("start", F.col("offset") + F.col("local"))
        .drop("offset", "local", *([] if keep_block else ["block"]))
    )


def elbow(
    hist: DataFrame,
    keys: list[str],
    value: str,
    weight: str = "n",
    gap: float | None = None,
    short: str = "zero",
    rows: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Knee of each descending curve: ``keys..., i, d, x, y``.

    Position and value are scaled to [0, 1]; the knee is the first point farthest
    below the chord from the first to the last point, or the first point when none
    lies below. ``gap`` admits only points more than that far below the chord.
    Among equal values the first has the largest distance, so one point per
    distinct value suffices. Curves of fewer than three points give zeros, or
    raise with ``short='error'``.
    """
    points = with_positions(hist, keys, value, weight, rows, hot_rows)
    x = F.col("start") / (F.col("total") - 1)
    y = (F.col(value) - F.col("y_last")) / (F.col("y_first") - F.col("y_last"))
    bent = (F.col("y_first") > F.col("y_last")) & (F.col("total") >= 3)
    d = F.when(bent, ((1.0 - y) - x) * 2.0**0.5 / 2.0)
    admitted = d > 0
    if gap is not None:
        admitted = admitted & F.when(bent, y < (1.0 - gap - x))
    candidate = F.when(admitted, d)
    best = points.select(*keys, "start", "total", "y_first", F.col(value).cast("double").alias("_y"), candidate.alias("_d"))
    best = best.groupBy(*keys).agg(
        F.max(F.struct("_d", (-F.col("start")).alias("_i"), "_y")).alias("top"),
        F.first("total").alias("total"),
        F.first("y_first").alias("y_first"),
    )
    found = F.col("top._d").isNotNull()
    short_value = F.lit(0.0) if short == "zero" else F.raise_error(F.lit("a curve needs at least three points"))
    return best.select(
        *keys,
        F.when(found, -F.col("top._i")).otherwise(0).cast("double").alias("i"),
        F.coalesce("top._d", F.lit(0.0)).alias("d"),
        F.when(found, -F.col("top._i")).otherwise(0).cast("double").alias("x"),
        F.when(F.col("total") < 3, short_value.cast("double"))
        .when(found, F.col("top._y"))
        .otherwise(F.col("y_first").cast("double"))
        .alias("y"),
    )

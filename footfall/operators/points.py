"""Keyword points and their weighted distinct locations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators.joins import BROADCAST_ROWS, lookup_join
from footfall.operators.text import explode_tags

PLACE = ["term", "lon", "lat"]
MIN_POINTS = 50
# One hash bucket should hold about this many points of a keyword.
BUCKET_ROWS = 65_536
HASH_BITS = 31


def keyword_points(posts: DataFrame, keywords: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One point per tag occurrence that equals a keyword: ``term, post_id, pos, lon, lat``."""
    tags = explode_tags(posts.select("post_id", "longitude", "latitude", "tags"))
    rows = tags.select(
        F.col("tag").alias("term"), "post_id", "pos", F.col("longitude").alias("lon"), F.col("latitude").alias("lat")
    )
    return lookup_join(rows, keywords.select("term").distinct(), ["term"], ["post_id"], broadcast_rows=broadcast_rows)


def term_sizes(points: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Keywords with more than ``min_points`` points: ``term, n``."""
    return points.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_points)


def min_points(points: DataFrame, minimum: int = MIN_POINTS) -> DataFrame:
    """Points of the keywords with more than ``minimum`` points."""
    return lookup_join(points, term_sizes(points, minimum).select("term"), ["term"], ["post_id", "pos"])


def sample_order() -> list:
    """Fixed pseudo-random order of points: a linear congruential hash of the post id,
    then post id and tag position."""
    mixed = (F.pmod(F.col("post_id"), F.lit(2**HASH_BITS)) * 1103515245 + 12345) % 2**HASH_BITS
    return [mixed, F.col("post_id"), F.col("pos")]


def cap_points(points: DataFrame, cap: int | None) -> DataFrame:
    """A sample that the caller asks for: at most ``cap`` points of each keyword, drawn
    in a fixed pseudo-random order. Nothing else in the package samples by default.

    The hash range is cut into buckets of about ``BUCKET_ROWS`` points, counted
    per keyword. Buckets below the one in which the cap falls are kept without
    sorting, and only that one bucket is ranked. ``None`` keeps every point.
    """
    if cap is None:
        return points
    sizes = points.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    bits = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / BUCKET_ROWS))).cast("int")
    sizes = sizes.select("term", "n", F.least(bits, F.lit(HASH_BITS)).alias("bits"))
    mixed = sample_order()[0]
    spread = lookup_join(points, sizes, ["term"], ["post_id", "pos"]).withColumn("hash", mixed)
    spread = spread.withColumn("bucket", F.expr(f"shiftright(hash, {HASH_BITS} - bits)"))
    counts = spread.filter(F.col("n") > cap).groupBy("term", "bucket").agg(F.count(F.lit(1)).alias("m"))
    upto = Window.partitionBy("term").orderBy("bucket")
    counts = counts.withColumn("filled", F.sum("m").over(upto))
    cut = counts.filter((F.col("filled") >= cap) & (F.col("filled") - F.col("m") < cap)).select(
        "term", F.col("bucket").alias("cut_bucket"), (F.lit(cap) - F.col("filled") + F.col("m")).alias("quota")
    )
    # One row per capped keyword; the planner broadcasts it or splits a hot keyword.
    marked = spread.join(cut, "term", "left")
    columns = points.columns
    whole = marked.filter(F.col("cut_bucket").isNull() | (F.col("bucket") < F.col("cut_bucket"))).select(columns)
    order = Window.partitionBy("term").orderBy("hash", "post_id", "pos")
    partial = (
        marked.filter(F.col("bucket") == F.col("cut_bucket"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= F.col("quota"))
        .select(columns)
    )
    return whole.unionByName(partial)


def weighted_locations(points: DataFrame) -> DataFrame:
    """Distinct locations per keyword with the number ``w`` of points on each."""
    return points.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("w"))

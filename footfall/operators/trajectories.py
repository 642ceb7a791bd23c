"""Visits of regions and the daily place sets and sequences of users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.operators.joins import BROADCAST_ROWS, HOT_ROWS
from footfall.operators.spatial import point_in_roi
from footfall.session import stage
from footfall.sources.posts import DATE_PATTERN

DAY = ["username", "day"]


def posted_at() -> Column:
    """Time of the date text ``date_posted``; null when it does not parse."""
    return F.try_to_timestamp("date_posted", F.lit(DATE_PATTERN))


def rejected_dates(posts: DataFrame) -> DataFrame:
    """Posts whose date does not parse; they take no part in visits."""
    return posts.filter(posted_at().isNull())


def visits(
    posts: DataFrame, rois: DataFrame, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """One row per post and region that holds it: ``username, day, poi, ts``."""
    slim = posts.select("post_id", "longitude", "latitude", "username", "date_posted")
    hits = point_in_roi(slim, rois, broadcast_rows, hot_rows).withColumn("ts", posted_at())
    return hits.filter(F.col("ts").isNotNull()).select("username", F.to_date("ts").alias("day"), "poi", "ts")


def user_day_places(visit_rows: DataFrame) -> DataFrame:
    """Set of places per user and day, as the sorted array ``places``.

    Sets are merged before the shuffle and cannot outgrow the number of regions.
    """
    return visit_rows.groupBy(*DAY).agg(F.sort_array(F.collect_set("poi")).alias("places"))


def transactions(day_places: DataFrame) -> DataFrame:
    """Place sets as the basket column ``items``."""
    return day_places.select(F.sort_array("places").alias("items"))


def encode_places(rois: DataFrame) -> DataFrame:
    """Dictionary of place names and integers from 0, in name order: ``poi, code``.

    The sorted names are numbered within their partition; offsets come from the
    partition sizes.
    """
    names = rois.select("poi").distinct().sort("poi")
    local = stage(names.withColumn("id", F.monotonically_increasing_id()), "names")
    local = local.withColumns({"part": F.shiftright("id", 33), "local": F.col("id").bitwiseAND(2**33 - 1)})
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = local.groupBy("part").agg(F.count(F.lit(1)).alias("m"))
    offsets = sizes.select("part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    return local.join(offsets, "part").select("poi", (F.col("offset") + F.col("local")).cast("int").alias("code"))


def user_day_sequences(visit_rows: DataFrame) -> DataFrame:
    """Places of each user and day in the order of the first visit, ties by name.

    ``sequence`` holds one-element arrays, the shape the sequence miner expects.
    """
    first = visit_rows.groupBy(*DAY, "poi").agg(F.min("ts").alias("first_ts"))
    ordered = F.array_sort(F.collect_list(F.struct("first_ts", "poi")))
    return first.groupBy(*DAY).agg(F.transform(ordered, lambda v: F.array(v["poi"])).alias("sequence"))

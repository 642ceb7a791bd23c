"""Distance of each point to its k-th nearest neighbour, as a distributed grid search."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.geo import EARTH_RADIUS_KM, distance_m, m_to_degree
from footfall.functions.grid import curve_position, explode_sphere_cover, with_sphere_cell
from footfall.operators.joins import BROADCAST_ROWS, HOT_ROWS, lookup_join, salted_join
from footfall.operators.points import PLACE
from footfall.session import stage

NEIGHBOURS = 4
# From about the step of seven-decimal coordinates to 65 km.
FIRST_SIDE_M = 4.0 / 4**4
LEVELS = 12
CROWDED = 24
HALF_CIRCLE_M = math.pi * EARTH_RADIUS_KM * 1000.0


def _with_side(locations: DataFrame) -> DataFrame:
    """Add the ``side`` of the search cells of each place, in metres.

    It is about the side of the largest quadtree cell around the place that holds no
    more than ``CROWDED`` places of the keyword, so a crowded spot makes cells small
    around itself only. In curve order a cell is a run of places: a cell with more
    contains one of the runs of ``CROWDED`` + 1 that the place is in, and the first
    bits that the ends of a run share give its cell. Runs are cut at the borders of
    partitions, where cells may come out larger; the choice affects only the work.
    """
    at = locations.withColumn("z", curve_position(F.col("lon"), F.col("lat")))
    dealt = at.repartitionByRange("term", "z").withColumn("part", F.spark_partition_id())
    order = Window.partitionBy("term", "part").orderBy("z")
    differ = F.col("z").bitwiseXOR(F.lead("z", CROWDED).over(order))
    level = F.when(differ == 0, 0).otherwise(F.floor(F.floor(F.log2(differ.cast("double"))) / 2) + 1)
    runs = dealt.withColumn("run_level", level.cast("int"))
    crowded = F.min("run_level").over(order.rowsBetween(-CROWDED, 0))
    steps = F.floor((F.coalesce(crowded, F.lit(2 * LEVELS)) - 1) / 2)
    steps = F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), steps))
    return runs.withColumn("side", F.pow(F.lit(4.0), steps) * FIRST_SIDE_M).drop("z", "part", "run_level")


def knn_distance(
    locations: DataFrame,
    k: int = NEIGHBOURS,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``dist``, the metres to the k-th nearest point at another location.

    ``locations`` are distinct places with a weight ``w`` per keyword; points on
    the same spot do not count as neighbours of each other, but each of them counts
    for everyone else. Places with fewer than k points elsewhere are left out: their
    keyword has at most k places and cannot form a region.

    Each round looks for neighbours within one cell side of the place, in the cells
    around it. A point that finds k there is done, since anything missed is farther
    away than the side. The others go on with cells twice as large.
    """
    locations = stage(locations, "locations")
    rows = locations.count()
    totals = stage(locations.groupBy("term").agg(F.sum("w").alias("total")), "totals")
    terms = totals.count()
    placed = lookup_join(_with_side(locations), totals, ["term"], ["lon", "lat"], terms, broadcast_rows, hot_rows)
    # A number sorts and shuffles the pairs of a place more cheaply than its keyword and coordinates.
    numbered = placed.filter(F.col("total") - F.col("w") >= k).drop("total").withColumn("id", F.monotonically_increasing_id())
    open_points = stage(numbered, "open")
    open_rows, factor, done = open_points.count(), 1.0, []
    while open_rows:
        found = stage(_round(locations, open_points, factor, k, rows, open_rows, terms, broadcast_rows, hot_rows), "knn")
        done.append(found.filter(F.col("dist").isNotNull()))
        open_points = found.filter(F.col("dist").isNull()).drop("dist")
        open_rows = open_points.count()
        # Few open points make few pairs even in large cells.
        factor *= 4.0 if open_rows <= broadcast_rows // 16 else 2.0
    if not done:
        return locations.select(*PLACE, "w", F.lit(None).cast("double").alias("dist"))
    return reduce(DataFrame.unionByName, done).select(*PLACE, "w", "dist")


def candidate_pairs(every, open_points, factor, rows, open_rows, terms, broadcast_rows, hot_rows, *keep: str) -> DataFrame:
    """Open points, with their columns ``keep``, and the places in the cells around them.

    Points with cells of one size meet on the grid of that size. Every place is laid
    out once for each size that open points of its keyword still use: at most
    ``LEVELS``, and few after the first round.
    """
    reach = F.least(F.col("side") * factor, F.lit(HALF_CIRCLE_M))
    side = m_to_degree(reach)
    queries = open_points.select("term", F.col("lon").alias("q_lon"), F.col("lat").alias("q_lat"), "side", *keep)
    queries = explode_sphere_cover(queries, side, side, "q_lat", "q_lat", "q_lon", "q_lon")
    used = open_points.groupBy("term").agg(F.collect_set("side").alias("sides"))
    cells = lookup_join(every, used, ["term"], ["lon", "lat"], terms, broadcast_rows, hot_rows)
    cells = with_sphere_cell(cells.withColumn("side", F.explode("sides")).drop("sides"), side)
    keys = ["term", "side", "row", "col"]
    if open_rows <= broadcast_rows // 16:
        return cells.join(F.broadcast(queries), keys)
    return salted_join(cells, queries, keys, ["lon", "lat"], rows=rows, hot_rows=hot_rows)


def _round(every, open_points, factor, k, rows, open_rows, terms, broadcast_rows, hot_rows) -> DataFrame:
    """Search one cell side around the open points; ``dist`` stays null without k neighbours."""
    pairs = candidate_pairs(every, open_points, factor, rows, open_rows, terms, broadcast_rows, hot_rows, "id")
    reach = F.least(F.col("side") * factor, F.lit(HALF_CIRCLE_M))
    apart = (F.col("lon") != F.col("q_lon")) | (F.col("lat") != F.col("q_lat"))
    pairs = pairs.filter(apart).withColumn("d", distance_m(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon")))
    pairs = pairs.filter(F.col("d") <= reach).select("id", "w", "d")
    # Every place weighs at least one point, so the k nearest places suffice; the
    # planner applies the limit before the shuffle.
    near = Window.partitionBy("id").orderBy("d")
    nearest = pairs.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)
    nearest = nearest.withColumn("reached", F.sum("w").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    kth = nearest.groupBy("id").agg(F.min(F.when(F.col("reached") >= k, F.col("d"))).alias("dist"))
    return open_points.join(kth, "id", "left")


def distance_curve(distances: DataFrame) -> DataFrame:
    """Histogram of the k-th neighbour distances per keyword: ``term, dist, n``.

    A place of weight w stands for w points with the same distance.
    """
    return distances.groupBy("term", "dist").agg(F.sum("w").alias("n"))

"""Regions of interest: the convex hull of the largest cluster of each keyword."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.geo import RING_TYPE, closed
from footfall.operators.cluster import MIN_PTS, dbscan, largest_cluster
from footfall.operators.joins import BROADCAST_ROWS, HOT_ROWS, lookup_join
from footfall.operators.knn import NEIGHBOURS, distance_curve, knn_distance
from footfall.operators.points import MIN_POINTS, cap_points, keyword_points, min_points, weighted_locations
from footfall.operators.radius import THRESHOLD, eps_threshold
from footfall.session import stage


# Coordinates with up to nine decimals become whole numbers and are compared without rounding.
DECIMALS = 1e9
# Bound of the rounding of a turn in units of the coordinates' size, with room to spare.
ROUNDING = 2.0**-50


def _whole(values: np.ndarray) -> list[int] | None:
    """The values as whole numbers of the last decimal, or None when one of them has more decimals."""
    scaled = np.round(values * DECIMALS)
    return scaled.astype(np.int64).tolist() if np.array_equal(scaled / DECIMALS, values) else None


def _turn(o: tuple, a: tuple, b: tuple) -> int | float | Fraction:
    """Above zero where o, a, b turn left, zero on one line; without rounding.

    Coordinates stand for the decimals they are written as. Whole numbers are exact as
    they are; floats are tried first, and where the outcome could be rounding the
    decimals decide.
    """
    left, right = (a[0] - o[0]) * (b[1] - o[1]), (a[1] - o[1]) * (b[0] - o[0])
    if isinstance(left, int):
        return left - right
    size = max(map(abs, (*o, *a, *b)))
    spans = abs(a[0] - o[0]) + abs(b[1] - o[1]) + abs(a[1] - o[1]) + abs(b[0] - o[0])
    if abs(left - right) > ROUNDING * size * spans:
        return left - right
    o, a, b = (tuple(Fraction(repr(x)) for x in p) for p in (o, a, b))
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _hull(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hull vertices, counter-clockwise from the smallest; fewer than three for a line.

    Only true corners are vertices: places on a side are left out, also where binary
    coordinates put them a little beside it.
    """
    order = np.lexsort((lat, lon))
    lon, lat = lon[order], lat[order]
    # Only the lowest and the highest place of each longitude can be a vertex.
    change = np.flatnonzero(np.diff(lon)) + 1
    ends = np.unique(np.concatenate([[0], change, change - 1, [len(lon) - 1]]))
    lon, lat = lon[ends], lat[ends]
    x, y = _whole(lon), _whole(lat)
    points = list(zip(lon.tolist(), lat.tolist())) if x is None or y is None else list(zip(x, y))
    points = [(*p, k) for k, p in enumerate(points)]

    def chain(ordered: list) -> list:
        out: list = []
        for p in ordered:
            while len(out) > 1 and _turn(out[-2][:2], out[-1][:2], p[:2]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = chain(points) + chain(points[::-1]) if len(points) > 1 else points
    at = [k for *_, k in ring]
    return lon[at], lat[at]


def _partial_hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hull per keyword of the rows of one partition, merged batch by batch."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for term, rows in batch.groupby("term"):
            lon, lat = held.get(term, (np.empty(0), np.empty(0)))
            held[term] = _hull(np.append(lon, rows["lon"].to_numpy()), np.append(lat, rows["lat"].to_numpy()))
    for term, (lon, lat) in held.items():
        yield pd.DataFrame({"term": term, "lon": lon, "lat": lat})


def _final_hull(rows: pd.DataFrame) -> pd.DataFrame:
    lon, lat = _hull(rows["lon"].to_numpy(), rows["lat"].to_numpy())
    if len(lon) < 3:
        return pd.DataFrame({"term": [], "ring": []}, dtype=object)
    ring = [{"lon": x, "lat": y} for x, y in zip(lon.tolist(), lat.tolist())]
    return pd.DataFrame({"term": [rows["term"].iloc[0]], "ring": [ring + ring[:1]]})


def convex_hull(places: DataFrame, min_places: int = 3) -> DataFrame:
    """Closed hull ring of each keyword with more than ``min_places`` places: ``term, ring``.

    Places on one line give no ring. Hulls of hulls: every partition reduces its
    share to hull vertices first, so only those are brought together.
    """
    slim = places.select("term", "lon", "lat")
    enough = slim.groupBy("term").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > min_places).select("term")
    partial = slim.mapInPandas(_partial_hulls, "term string, lon double, lat double")
    rings = partial.groupBy("term").applyInPandas(_final_hull, f"term string, ring {RING_TYPE}")
    return rings.join(enough, "term", "left_semi")


def hull_close_ring(vertices: DataFrame) -> DataFrame:
    """Closed rings from open ones: ``term, ring``."""
    return vertices.withColumn("ring", closed(F.col("ring")))


def cluster_places(clusters: DataFrame, best: DataFrame) -> DataFrame:
    """Places of the chosen cluster of each keyword."""
    named = clusters.filter(F.col("label").isNotNull())
    return lookup_join(named, best.select("term", "label"), ["term", "label"], ["lon", "lat"]).select("term", "lon", "lat")


def extract_rois(
    posts: DataFrame,
    keywords: DataFrame,
    cap: int | None = None,
    neighbours: int = NEIGHBOURS,
    threshold: float = THRESHOLD,
    min_pts: int = MIN_PTS,
    minimum: int = MIN_POINTS,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Region of each keyword that has one: ``poi, ring``.

    All points are used. A caller may ask for a fixed sample of at most ``cap`` points
    per keyword, which goes through the same steps.
    """
    points = stage(keyword_points(posts, keywords, broadcast_rows), "points")
    points = min_points(points, minimum)
    if cap is not None:
        points = cap_points(stage(points, "frequent"), cap)
    locations = stage(weighted_locations(points), "locations")
    curve = distance_curve(knn_distance(locations, neighbours, broadcast_rows, hot_rows))
    eps = stage(eps_threshold(curve, threshold, hot_rows), "eps")
    clusters = dbscan(locations, eps, min_pts, hot_rows=hot_rows)
    hulls = convex_hull(cluster_places(clusters, largest_cluster(clusters, min_pts)))
    return hulls.withColumnRenamed("term", "poi")

"""Spatial joins as equi-joins on grid cells, with the exact test last.

Regions differ in size, so each is laid out on the level of a grid hierarchy on
which it covers a handful of cells. Only the levels that occur are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.geo import area_km2, distance_m, m_to_degree, planar_area, ring_contains
from footfall.functions.grid import explode_sphere_cover, with_sphere_cell
from footfall.operators.joins import BROADCAST_ROWS, HOT_ROWS, lookup_join
from footfall.operators.rings import (
    EDGES_PER_ROW,
    SLAB,
    WHOLE_RING,
    edges_contain,
    join_slabs,
    overlap,
    slab_edges,
    slab_of,
    whole_overlap,
    with_region,
    with_slabs,
    within,
)
from footfall.session import stage

BASE_DEGREES = 0.001
CELLS_PER_AXIS = 4
MAX_LEVEL = 10
GRID = ["level", "gy", "gx"]


def _width(level: Column) -> Column:
    return F.pow(F.lit(4.0), level) * BASE_DEGREES


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / _width(level))


def _with_level(rois: DataFrame) -> DataFrame:
    """Bounding box, key and grid level of each region."""
    boxed = with_region(rois)
    extent = F.greatest(F.col("box.lon_hi") - F.col("box.lon_lo"), F.col("box.lat_hi") - F.col("box.lat_lo"))
    level = F.ceil(F.log2(F.greatest(extent / (BASE_DEGREES * CELLS_PER_AXIS), F.lit(1.0))) / 2.0)
    return boxed.withColumn("own_level", F.least(level, F.lit(MAX_LEVEL)).cast("int"))


def _small() -> Column:
    return F.size("ring") <= WHOLE_RING + 1


def _levels(boxed: DataFrame) -> list[int]:
    """Levels in use: at most ``MAX_LEVEL + 1`` integers."""
    return sorted(r[0] for r in boxed.select("own_level").distinct().collect())


def _explode_cells(boxed: DataFrame, level: Column) -> DataFrame:
    """One row per cell of the bounding box on ``level``."""
    gy = F.explode(F.sequence(_cell(F.col("box.lat_lo"), level), _cell(F.col("box.lat_hi"), level))).alias("gy")
    gx = F.explode(F.sequence(_cell(F.col("box.lon_lo"), level), _cell(F.col("box.lon_hi"), level))).alias("gx")
    return boxed.withColumn("level", level).select("*", gy).select("*", gx)


def _lookup_points(
    points: DataFrame, boxed: DataFrame, lon: str, lat: str, salt_by: list[str], broadcast_rows: int, hot_rows: int
) -> tuple[DataFrame, bool]:
    """Pairs of a point and a region whose bounding box holds it, and whether any region is large.

    Large rings stay behind: their pairs have none.
    """
    carried = boxed.withColumn("ring", F.when(_small(), F.col("ring")))
    cells = stage(_explode_cells(carried, F.col("own_level")), "cells")
    size = 1 + F.coalesce(F.size("ring"), F.lit(0)) / EDGES_PER_ROW
    levels, rows, large = cells.agg(
        F.sort_array(F.collect_set("own_level")), F.coalesce(F.sum(size), F.lit(0.0)), F.coalesce(F.bool_or(F.col("ring").isNull()), F.lit(False))
    ).first()
    placed = points.select("*", F.explode(F.array(*[F.lit(level) for level in levels or [0]])).alias("level"))
    placed = placed.select(
        "*", _cell(F.col(lat), F.col("level")).alias("gy"), _cell(F.col(lon), F.col("level")).alias("gx")
    )
    pairs = lookup_join(placed, cells.drop("own_level"), GRID, salt_by, int(rows), broadcast_rows, hot_rows)
    inside = F.col(lon).between(F.col("box.lon_lo"), F.col("box.lon_hi"))
    pairs = pairs.filter(inside & F.col(lat).between(F.col("box.lat_lo"), F.col("box.lat_hi"))).drop(*GRID)
    return pairs, large


def point_in_roi(
    posts: DataFrame, rois: DataFrame, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Posts with the name ``poi`` of each region that holds them, borders included.

    A post is tested against the whole ring of a small region, and against the edges of
    its latitude slab of a large one.
    """
    boxed = with_slabs(_with_level(rois), "lat")
    pairs, large = _lookup_points(posts, boxed, "longitude", "latitude", ["post_id"], broadcast_rows, hot_rows)
    x, y, helpers = F.col("longitude"), F.col("latitude"), ["ring", "box", "region", *SLAB]
    small = pairs.filter(F.col("ring").isNotNull() & ring_contains(F.col("ring"), x, y)).drop(*helpers)
    if not large:
        return small
    slabs = stage(slab_edges(boxed.filter(~_small()), "lat"), "slabs")
    met = join_slabs(pairs.filter(F.col("ring").isNull()).withColumn("slab", slab_of(y)), slabs, ["post_id"], broadcast_rows, hot_rows)
    hits = met.filter(edges_contain(F.col("edges"), x, y)).drop(*helpers, "slab", "edges")
    return small.unionByName(hits)


def roi_within_roi(
    inner: DataFrame, container: DataFrame, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Pairs ``inner_poi, poi`` of a region inside another one; equal regions count.

    A region inside another has the corner of its box in the other's box, so the
    candidates are found like points. Rings may be concave, and of any size.
    """
    inners = stage(with_region(inner), "inner")
    outers = stage(with_slabs(_with_level(container), "lat"), "container")
    corners = inners.select(
        F.col("poi").alias("inner_poi"),
        F.col("region").alias("inner_region"),
        F.col("box").alias("inner_box"),
        F.col("box.lon_lo").alias("x"),
        F.col("box.lat_lo").alias("y"),
    )
    pairs, _ = _lookup_points(corners, outers, "x", "y", ["inner_poi"], broadcast_rows, hot_rows)
    pairs = pairs.filter(
        (F.col("inner_box.lon_hi") <= F.col("box.lon_hi")) & (F.col("inner_box.lat_hi") <= F.col("box.lat_hi"))
    )
    pairs = stage(pairs.select("inner_poi", "poi", "inner_region", "region"), "candidates")
    return within(pairs, inners, outers, broadcast_rows, hot_rows).select("inner_poi", "poi")


def overlap_candidates(rois: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of regions whose boxes meet, each once: ``poi, region, ring, lat_lo`` and the
    same with ``other_``; large rings stay behind as null.

    A pair meets on the higher of its two levels, in the cell of the corner where the
    boxes start to overlap. Regions wait on their own level for the other side's
    smaller ones, which alone are laid out on higher levels: two small regions never
    meet in a large cell.
    """
    carried = lambda regions: regions.withColumn("ring", F.when(_small(), F.col("ring")))
    left = stage(carried(_with_level(rois)), "left")
    right = stage(carried(_with_level(others)), "right")
    levels = F.array(*[F.lit(level) for level in sorted({*_levels(left), *_levels(right)}) or [0]])

    def climbing(boxed: DataFrame, least: Column) -> DataFrame:
        usable = F.filter(levels, lambda level: level >= least)
        return _explode_cells(boxed.select("*", F.explode(usable).alias("at")), F.col("at")).drop("at")

    def named(boxed: DataFrame) -> DataFrame:
        return boxed.withColumnsRenamed({c: f"other_{c}" for c in ("poi", "ring", "box", "region", "own_level")})

    own = F.col("own_level")
    resting = _explode_cells(left, own).join(named(climbing(right, own)), GRID)
    rising = climbing(left, own + 1).join(named(_explode_cells(right, own)), GRID)
    x = F.greatest("box.lon_lo", "other_box.lon_lo")
    y = F.greatest("box.lat_lo", "other_box.lat_lo")
    once = (
        (_cell(y, F.col("level")) == F.col("gy"))
        & (_cell(x, F.col("level")) == F.col("gx"))
        & (x <= F.least("box.lon_hi", "other_box.lon_hi"))
        & (y <= F.least("box.lat_hi", "other_box.lat_hi"))
    )
    names = ["poi", "region", "ring", "other_poi", "other_region", "other_ring"]
    lows = [F.col("box.lat_lo").alias("lat_lo"), F.col("other_box.lat_lo").alias("other_lat_lo")]
    return resting.unionByName(rising).filter(once).select(*names, *lows)


def _with_overlap(pairs: DataFrame, rois: DataFrame, others: DataFrame) -> DataFrame:
    """Add the common ``area`` in square degrees: small rings as a whole, others by slabs."""
    base = F.least("lat_lo", "other_lat_lo")
    whole = F.col("ring").isNotNull() & F.col("other_ring").isNotNull()
    small = pairs.filter(whole).withColumn("area", whole_overlap(F.col("ring"), F.col("other_ring"), base))
    left, right = (with_region(side) for side in (rois, others))
    if left.filter(~_small()).isEmpty() and right.filter(~_small()).isEmpty():
        return small
    rest = stage(pairs.filter(~whole), "pairs")
    sums = overlap(rest, left, right)
    zero = F.coalesce("area", F.lit(0.0))
    return small.unionByName(rest.join(sums, ["region", "other_region"], "left").withColumn("area", zero))


def roi_overlap(rois: DataFrame, others: DataFrame) -> DataFrame:
    """Regions that share area with other regions: ``poi, other_poi, area`` in square degrees."""
    pairs = _with_overlap(overlap_candidates(rois, others), rois, others)
    return pairs.select("poi", "other_poi", "area").filter(F.col("area") > 0)


def roi_area(rois: DataFrame, planar: bool = False) -> DataFrame:
    """Area of each region in square kilometres: ``poi, area_km2``."""
    return rois.select("poi", area_km2(F.col("ring"), planar).alias("area_km2"))


def roi_quality(real: DataFrame, found: DataFrame) -> DataFrame:
    """How well found regions match the real ones of the same name.

    ``tp`` is the common area, ``fp`` the rest of the found and ``fn`` the rest of
    the real region, in square degrees. Real regions without a match keep null
    measures, so they stay visible.
    """
    real, found = stage(real.select("poi", "ring"), "real"), stage(found.select("poi", "ring"), "found")
    carried = F.when(_small(), F.col("ring")).alias("ring")
    side = lambda rois: with_region(rois).select("poi", "region", carried, F.col("box.lat_lo").alias("lat_lo"), planar_area(F.col("ring")).alias("area"))
    other = side(found).withColumnsRenamed({c: f"other_{c}" for c in ("region", "ring", "lat_lo")}).withColumnRenamed("area", "found_area")
    pairs = side(real).withColumnRenamed("area", "real_area").join(other, "poi", "left")
    met = _with_overlap(pairs.filter(F.col("other_region").isNotNull()), real, found).withColumnRenamed("area", "tp")
    alone = pairs.filter(F.col("other_region").isNull()).withColumn("tp", F.lit(None).cast("double"))
    areas = met.unionByName(alone).select("poi", F.col("other_region").isNotNull().alias("matched"), "tp", "found_area", "real_area")
    matched = F.col("matched")
    areas = areas.select(
        "poi",
        "matched",
        F.when(matched, F.col("tp")).alias("tp"),
        F.when(matched, F.greatest(F.lit(0.0), F.col("found_area") - F.col("tp"))).alias("fp"),
        F.when(matched, F.greatest(F.lit(0.0), F.col("real_area") - F.col("tp"))).alias("fn"),
    )
    precision = F.try_divide("tp", F.col("tp") + F.col("fp"))
    recall = F.try_divide("tp", F.col("tp") + F.col("fn"))
    scored = areas.select("*", precision.alias("precision"), recall.alias("recall"))
    f1 = F.try_divide(2.0 * F.col("recall") * F.col("precision"), F.col("recall") + F.col("precision"))
    return scored.withColumn("f1", f1)


def within_radius(
    posts: DataFrame, centres: DataFrame, radius_m: float, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Posts at most ``radius_m`` metres from each centre ``name, lon, lat``, with ``dist``."""
    side = m_to_degree(F.lit(float(radius_m)))
    cells = explode_sphere_cover(centres.select("name", "lon", "lat"), side, side)
    placed = with_sphere_cell(posts, side, "latitude", "longitude")
    pairs = lookup_join(
        placed, cells, ["row", "col"], ["post_id"], broadcast_rows=broadcast_rows, hot_rows=hot_rows
    )
    d = distance_m(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon"))
    return pairs.withColumn("dist", d).filter(F.col("dist") <= radius_m).drop("row", "col", "lon", "lat")


def bbox_filter(posts: DataFrame, lat_lo: float, lon_lo: float, lat_hi: float, lon_hi: float) -> DataFrame:
    """Posts in a box, borders included; reaches the scan of stored posts."""
    return posts.filter(F.col("latitude").between(lat_lo, lat_hi) & F.col("longitude").between(lon_lo, lon_hi))

"""Density clustering of weighted locations on a grid finer than the radius.

Cells are so small that all places in one lie within the radius of each other.
A cell with more than ``min_pts`` points therefore consists of core points of one
cluster, without looking at a single pair. Places in other cells are few per cell,
so their neighbour searches stay linear in the number of points. Clusters are the
connected components of the graph of core cells.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.geo import box_distance_bounds, distance_m, m_to_degree
from footfall.functions.grid import explode_sphere_cover, with_sphere_cell
from footfall.operators.joins import HOT_ROWS, hot_keys, lookup_join, salted_join
from footfall.operators.points import PLACE
from footfall.session import stage

MIN_PTS = 4
CELL = ["term", "row", "col"]
PAIR = ["term", "a_row", "a_col", "b_row", "b_col"]
# Two boxes with at most this many pairs of core places are compared place by place.
BOX_PAIRS = 1024
SPLIT = 8
# Links that one task joins up at a time, and the side of a tile in cells.
GROUP_LINKS = 200_000
TILE = 64


def _side(eps: Column) -> Column:
    """Cell side in degrees whose diagonal stays within the radius.

    0.7 is just below the root of one half; radii beyond 500 km get a wider margin
    for the curvature.
    """
    return m_to_degree(F.when(eps <= 500000.0, eps * 0.7).otherwise(eps * 0.4))


def with_radius(locations: DataFrame, eps: DataFrame) -> DataFrame:
    """Attach the radius and the cell of each location; keywords without a radius drop out."""
    placed = lookup_join(locations, eps.select("term", "eps"), ["term"], ["lon", "lat"])
    return with_sphere_cell(placed, _side(F.col("eps")))


def _within_eps(queries: DataFrame, placed: DataFrame, rows: int | None, hot_rows: int) -> DataFrame:
    """Pairs of a query place (``q_lon, q_lat``) and a place at most the radius apart."""
    renamed = queries.select("term", F.col("lon").alias("q_lon"), F.col("lat").alias("q_lat"), "eps")
    eps = F.col("eps")
    cover = explode_sphere_cover(renamed, _side(eps), m_to_degree(eps), "q_lat", "q_lat", "q_lon", "q_lon")
    pairs = salted_join(placed.drop("eps"), cover, CELL, ["lon", "lat"], rows=rows, hot_rows=hot_rows)
    d = distance_m(F.col("q_lat"), F.col("q_lon"), F.col("lat"), F.col("lon"))
    return pairs.filter(d <= eps)


def eps_neighbours(
    locations: DataFrame, eps: DataFrame, box_pairs: int = BOX_PAIRS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Number of points within the radius of each place, one point of the place itself
    left out: ``term, lon, lat, neighbours``.

    A box of places that lies within the radius of another box as a whole counts
    with its weight. Pairs of boxes that the radius cuts through are compared place
    by place when small, and split into finer boxes otherwise.
    """
    locations = stage(locations, "locations")
    places = with_radius(locations, stage(eps, "eps")).withColumn("box", F.lit(0).cast("bigint"))
    places = stage(places, "placed")
    boxes = stage(_box_stats(places, [*CELL, "box"]), "cells")
    extra, counts = ["box", "w", "eps"], []
    reach = m_to_degree(F.col("a_eps"))
    cover = explode_sphere_cover(
        _ends(boxes, "a", extra), _side(F.col("a_eps")), reach, "a_lat_lo", "a_lat_hi", "a_lon_lo", "a_lon_hi"
    ).withColumnsRenamed({"row": "b_row", "col": "b_col"})
    pairs = cover.join(_ends(boxes, "b", ["box", "w"]), ["term", "b_row", "b_col"])
    # A box of several places always falls into smaller ones, so the pairs get small.
    while True:
        pairs = stage(_judge(pairs.withColumnRenamed("a_eps", "eps")), "box_pairs")
        whole = pairs.filter("linked").groupBy("term", "a_row", "a_col", "a_box").agg(F.sum("b_w").alias("near"))
        whole = whole.withColumnsRenamed({"a_row": "row", "a_col": "col", "a_box": "box"})
        counts.append(salted_join(places, whole, [*CELL, "box"], ["lon", "lat"], hot_rows=hot_rows).select(*PLACE, "near"))
        small = F.col("a_m") * F.col("b_m") <= box_pairs
        cut = _close_places(pairs.filter(~F.col("linked") & small), places, ["box"])
        cut = cut.groupBy("term", F.col("a_lon").alias("lon"), F.col("a_lat").alias("lat"))
        counts.append(cut.agg(F.sum("b_w").alias("near")).select(*PLACE, "near"))
        large = pairs.filter(~F.col("linked") & ~small).select(*PAIR, "a_box", "b_box")
        if large.isEmpty():
            break
        places, boxes = _finer_boxes(places, boxes, large, hot_rows)
        pairs = _finer_pairs(large, boxes, extra, ["box", "w"])
        places, boxes = places.drop("parent"), boxes.drop("parent")
    total = reduce(DataFrame.unionByName, counts).groupBy(*PLACE)
    return total.agg((F.sum("near") - 1).alias("neighbours"))


def core_points(
    locations: DataFrame, eps: DataFrame, min_pts: int = MIN_PTS, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Places with their cell and the flag ``core``: at least ``min_pts`` neighbours."""
    locations = stage(locations, "locations")
    rows = locations.count()
    placed = with_radius(locations, stage(eps, "eps"))
    weights = placed.groupBy(*CELL).agg(F.sum("w").alias("cell_w"))
    marked = salted_join(placed, weights, CELL, ["lon", "lat"], rows=rows, hot_rows=hot_rows)
    marked = stage(marked.withColumn("full", F.col("cell_w") > min_pts).drop("cell_w"), "cells")
    loose = marked.filter(~F.col("full"))
    pairs = _within_eps(loose, placed, rows, hot_rows)
    enough = pairs.groupBy("term", "q_lon", "q_lat").agg((F.sum("w") - 1 >= min_pts).alias("core"))
    enough = enough.select("term", F.col("q_lon").alias("lon"), F.col("q_lat").alias("lat"), "core")
    loose = loose.drop("full").join(enough, PLACE)
    return marked.filter("full").drop("full").withColumn("core", F.lit(True)).unionByName(loose)


def _box(prefix: str = "") -> dict[str, Column]:
    return {name: F.col(prefix + name) for name in ("lat_lo", "lat_hi", "lon_lo", "lon_hi")}


def _box_stats(places: DataFrame, keys: list[str]) -> DataFrame:
    return places.groupBy(*keys).agg(
        F.first("eps").alias("eps"),
        F.count(F.lit(1)).alias("m"),
        F.sum("w").alias("w"),
        F.min("lat").alias("lat_lo"),
        F.max("lat").alias("lat_hi"),
        F.min("lon").alias("lon_lo"),
        F.max("lon").alias("lon_hi"),
        F.min(F.struct("lat", "lon")).alias("first_place"),
    )


def _judge(pairs: DataFrame) -> DataFrame:
    """Add ``linked`` (surely within the radius) and drop pairs that surely are not."""
    lower, upper = box_distance_bounds(_box("a_"), _box("b_"))
    near = pairs.withColumn("_lower", lower).filter(F.col("_lower") <= F.col("eps")).drop("_lower")
    return near.withColumn("linked", upper <= F.col("eps"))


def _ends(stats: DataFrame, end: str, extra: list[str]) -> DataFrame:
    names = ["m", "lat_lo", "lat_hi", "lon_lo", "lon_hi"]
    keys = [F.col(c).alias(f"{end}_{c}") for c in ("row", "col", *extra)]
    return stats.select("term", *keys, *[F.col(c).alias(f"{end}_{c}") for c in names])


def _close_places(pairs: DataFrame, places: DataFrame, extra: list[str]) -> DataFrame:
    """Pairs of places within the radius, over pairs of small boxes."""

    def end(name: str) -> DataFrame:
        keys = [F.col(c).alias(f"{name}_{c}") for c in ("row", "col", *extra)]
        return places.select("term", *keys, *[F.col(c).alias(f"{name}_{c}") for c in ("lon", "lat", "w")])

    keys = ["row", "col", *extra]
    slim = pairs.select(*PAIR, *[f"{e}_{c}" for e in "ab" for c in extra], "eps")
    both = slim.join(end("a"), ["term", *[f"a_{c}" for c in keys]]).join(end("b"), ["term", *[f"b_{c}" for c in keys]])
    d = distance_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return both.filter(d <= F.col("eps"))


def _finer_boxes(places: DataFrame, boxes: DataFrame, large: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Places and statistics of the boxes of unsettled pairs, one level finer."""
    ends = large.select("term", F.col("a_row").alias("row"), F.col("a_col").alias("col"), F.col("a_box").alias("box"))
    ends = ends.union(large.select("term", "b_row", "b_col", "b_box")).distinct()
    places = stage(_split_boxes(places, boxes.join(ends, [*CELL, "box"]), hot_rows), "boxes")
    return places, stage(_box_stats(places, [*CELL, "parent", "box"]), "box_stats")


def _finer_pairs(large: DataFrame, boxes: DataFrame, a_extra: list[str], b_extra: list[str]) -> DataFrame:
    """Pairs of the finer boxes of unsettled pairs: a bounded number per pair."""
    pairs = large.withColumnsRenamed({"a_box": "a_parent", "b_box": "b_parent"})
    pairs = pairs.join(_ends(boxes, "a", ["parent", *a_extra]), ["term", "a_row", "a_col", "a_parent"])
    return pairs.join(_ends(boxes, "b", ["parent", *b_extra]), ["term", "b_row", "b_col", "b_parent"])


def _cell_links(core: DataFrame, cells: DataFrame, box_pairs: int, hot_rows: int) -> DataFrame:
    """Pairs of core cells that hold two core places within the radius.

    Bounding boxes settle most pairs. What they leave open is compared place by
    place when small, and otherwise split into finer boxes, level by level.
    """
    side, reach = _side(F.col("a_eps")), m_to_degree(F.col("a_eps"))
    cover = explode_sphere_cover(
        _ends(cells, "a", ["eps"]), side, reach, "a_lat_lo", "a_lat_hi", "a_lon_lo", "a_lon_hi"
    ).withColumnsRenamed({"row": "b_row", "col": "b_col"})
    ordered = F.struct("a_row", "a_col") < F.struct("b_row", "b_col")
    pairs = cover.filter(ordered).join(_ends(cells, "b", []), ["term", "b_row", "b_col"])
    pairs = stage(_judge(pairs.withColumnRenamed("a_eps", "eps")), "pairs")
    links = pairs.filter("linked").select(*PAIR)
    unsettled = pairs.filter(~F.col("linked"))
    small = F.col("a_m") * F.col("b_m") <= box_pairs
    links = links.unionByName(_close_places(unsettled.filter(small), core, []).select(*PAIR).distinct())
    large = unsettled.filter(~small)
    if large.isEmpty():
        return links

    box = F.lit(0).cast("bigint")
    places, boxes = core.withColumn("box", box), cells.withColumn("box", box)
    large = large.select(*PAIR, box.alias("a_box"), box.alias("b_box"))
    while True:
        places, boxes = _finer_boxes(places, boxes, large, hot_rows)
        pairs = _finer_pairs(large, boxes, ["box", "eps"], ["box"])
        pairs = stage(_judge(pairs.withColumnRenamed("a_eps", "eps")), "box_pairs")
        linked = pairs.filter("linked").select(*PAIR).distinct()
        links = links.unionByName(linked)
        unsettled = pairs.filter(~F.col("linked")).join(linked, PAIR, "left_anti")
        small = F.col("a_m") * F.col("b_m") <= box_pairs
        links = links.unionByName(_close_places(unsettled.filter(small), places, ["box"]).select(*PAIR))
        large = stage(unsettled.filter(~small).select(*PAIR, "a_box", "b_box"), "large")
        if large.isEmpty():
            break
        places, boxes = places.drop("parent"), boxes.drop("parent")
    return links.distinct()


def _split_boxes(places: DataFrame, parents: DataFrame, hot_rows: int) -> DataFrame:
    """Assign the places of each parent box to ``SPLIT`` by ``SPLIT`` finer boxes."""
    slim = parents.select(*CELL, "box", *_box().values())
    inside = salted_join(places, slim, [*CELL, "box"], ["lon", "lat"], hot_rows=hot_rows)

    def part(axis: str) -> Column:
        low, high = F.col(f"{axis}_lo"), F.col(f"{axis}_hi")
        scaled = F.floor((F.col(axis) - low) / (high - low) * SPLIT)
        return F.when(high > low, F.least(F.lit(SPLIT - 1), scaled)).otherwise(F.lit(0)).cast("bigint")

    # Boxes keep their parent, so two of them would have to share it to be mixed up, and
    # would then only count as one box.
    finer = F.xxhash64("box", part("lat"), part("lon"))
    return inside.select(*CELL, "lon", "lat", "w", "eps", F.col("box").alias("parent"), finer.alias("box"))


def _local_roots(links: pd.DataFrame) -> pd.DataFrame:
    """Smallest node of the component of each node, over one group of links.

    Nodes are numbered in order; every round hangs the larger root of a link below the
    smaller one and then jumps from root to root.
    """
    ends = [links[[f"{side}_row", f"{side}_col"]].to_numpy() for side in "ab"]
    nodes, code = np.unique(np.concatenate(ends), axis=0, return_inverse=True)
    a, b = np.split(code.ravel(), 2)
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, root[root]):
            root = root[root]
        apart = root[a] != root[b]
        a, b = root[a[apart]], root[b[apart]]
    out = np.concatenate([nodes, nodes[root]], axis=1)
    roots = pd.DataFrame(out, columns=["row", "col", "root_row", "root_col"])
    roots.insert(0, "term", links["term"].iloc[0])
    return roots


def connected_components(nodes: DataFrame, links: DataFrame, group_links: int = GROUP_LINKS) -> DataFrame:
    """Smallest cell of the component of each core cell: ``term, row, col, root_row, root_col``.

    Keywords with few links are settled one per task. Otherwise tiles of
    ``TILE`` by ``TILE`` cells, which hold a bounded number of links, are settled
    one per task; cells on which two tiles disagree connect the tiles' roots, and
    the much smaller graph of those roots is solved by :func:`_iterate_roots`.
    """
    links = stage(links, "links")
    local = "term string, row long, col long, root_row long, root_col long"
    if hot_keys(links, ["term"], hot_rows=group_links) is None:
        found = links.groupBy("term").applyInPandas(_local_roots, local)
    else:
        tile = [F.floor(F.col(c) / TILE).alias(f"tile_{c}") for c in ("a_row", "a_col")]
        seen = stage(links.groupBy("term", *tile).applyInPandas(_local_roots, local), "tiles")
        root = F.struct("root_row", "root_col")
        lowest = seen.groupBy("term", "row", "col").agg(F.min(root).alias("root"))
        claims = seen.join(lowest, ["term", "row", "col"]).select("term", "root", root.alias("other"))
        conflicts = claims.filter(F.col("root") != F.col("other")).distinct()
        settled = _iterate_roots(conflicts)
        merged = lowest.join(settled.withColumnRenamed("node", "root"), ["term", "root"], "left")
        final = F.coalesce("final", "root")
        found = merged.select("term", "row", "col", final["root_row"].alias("root_row"), final["root_col"].alias("root_col"))
    all_nodes = nodes.select("term", "row", "col").join(found, ["term", "row", "col"], "left")
    return all_nodes.select(
        "term", "row", "col",
        F.coalesce("root_row", "row").alias("root_row"),
        F.coalesce("root_col", "col").alias("root_col"),
    )


def _iterate_roots(links: DataFrame) -> DataFrame:
    """Smallest node of each component over links ``term, root, other``: ``term, node, final``.

    Every round takes the smallest root among the neighbours, hands it on to the
    node's own root, and then jumps from root to root. Rounds grow with the
    logarithm of the component's diameter; each is written down, so a lost executor
    costs one round.
    """
    both = links.select("term", F.col("root").alias("node"), "other")
    both = stage(both.union(both.select("term", "other", "node")), "links")
    roots = both.select("term", "node", F.col("node").alias("root")).distinct()
    moving = not both.isEmpty()
    while moving:
        known = roots.select("term", F.col("node").alias("other"), F.col("root").alias("other_root"))
        lowest = both.join(known, ["term", "other"]).groupBy("term", "node").agg(F.min("other_root").alias("low"))
        offers = roots.join(lowest, ["term", "node"]).withColumn("low", F.least("root", "low"))
        offers = offers.select("term", "node", "low").union(offers.select("term", "root", "low"))
        hooked = offers.groupBy("term", "node").agg(F.min("low").alias("up"))
        # Few distinct roots remain after the first rounds, so the planner can
        # broadcast the right side; before that no root is shared by many nodes.
        above = hooked.select("term", F.col("node").alias("up"), F.col("up").alias("root"))
        above = above.join(hooked.select("term", "up").distinct(), ["term", "up"])
        jumped = hooked.join(above, ["term", "up"]).select("term", "node", "root")
        before = roots.select("term", "node", F.col("root").alias("old"))
        fresh = stage(jumped.join(before, ["term", "node"]).withColumn("moved", F.col("root") != F.col("old")), "roots")
        moving = not fresh.filter("moved").isEmpty()
        roots = fresh.select("term", "node", "root")
    return roots.withColumnRenamed("root", "final")


def dbscan(
    locations: DataFrame,
    eps: DataFrame,
    min_pts: int = MIN_PTS,
    box_pairs: int = BOX_PAIRS,
    hot_rows: int = HOT_ROWS,
    group_links: int = GROUP_LINKS,
) -> DataFrame:
    """Cluster the places of each keyword: ``term, lon, lat, w, core, label``.

    A cluster is named by its smallest core place as ``struct<lat, lon>``. A border
    place joins the smallest cluster within reach; noise has no label.
    """
    places = stage(core_points(locations, eps, min_pts, hot_rows), "places")
    core = places.filter("core")
    cells = stage(_box_stats(core, CELL), "core_cells")
    roots = connected_components(cells, _cell_links(core, cells, box_pairs, hot_rows), group_links)
    component = ["term", "root_row", "root_col"]
    named = roots.join(cells.select(*CELL, "first_place"), CELL)
    names = named.groupBy(*component).agg(F.min("first_place").alias("label"))
    cell_labels = roots.join(names, component).select(*CELL, "label")
    clustered = stage(salted_join(core, cell_labels, CELL, ["lon", "lat"], hot_rows=hot_rows), "clustered")
    others = places.filter(~F.col("core"))
    touching = _within_eps(others, clustered.select(*CELL, "lon", "lat", "eps", "label"), None, hot_rows)
    borders = touching.groupBy("term", "q_lon", "q_lat").agg(F.min("label").alias("label"))
    borders = borders.select("term", F.col("q_lon").alias("lon"), F.col("q_lat").alias("lat"), "label")
    columns = [*PLACE, "w", "core", "label"]
    result = clustered.select(columns).unionByName(others.join(borders, PLACE, "left").select(columns))
    return stage(result, "clusters")


def largest_cluster(clusters: DataFrame, min_pts: int = MIN_PTS) -> DataFrame:
    """Keyword, name and size of the cluster with the most distinct places, if it has
    more than ``min_pts``; of equals the one with the smallest name."""
    sizes = clusters.filter(F.col("label").isNotNull()).groupBy("term", "label").agg(F.count(F.lit(1)).alias("places"))
    best = sizes.groupBy("term").agg(F.min(F.struct((-F.col("places")).alias("rank"), "label")).alias("best"))
    return best.select("term", "best.label", (-F.col("best.rank")).alias("places")).filter(F.col("places") > min_pts)

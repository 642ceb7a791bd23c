"""Rings by their edges: point tests, containment and overlap that never walk a whole large ring.

A ring is cut into slabs of equal width along one axis, and each slab lists the edges that
reach into it. The number of slabs follows from how far the ring runs back and forth, so
that all lists together hold at most four times the edges of the ring, whatever its shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.geo import BORDER, ring_box
from footfall.operators.joins import BROADCAST_ROWS, HOT_ROWS, lookup_join, salted_join
from footfall.session import stage

# An edge takes about this share of a typical row; used to bound broadcasts by size.
EDGES_PER_ROW = 4
# Rings of up to this many corners are tested whole, and pairs of such rings edge by edge.
WHOLE_RING = 64
SLAB = ["slab_lo", "slab_width", "slabs"]
# Share of the summed trapezoids below which an area is rounding.
ROUNDING = 1e-13


def edges(ring: Column) -> Column:
    """Edges of a closed ring as ``array<struct<ax, ay, bx, by>>``."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(
        F.slice(ring, F.lit(1), n),
        F.slice(ring, F.lit(2), n),
        lambda a, b: F.struct(a["lon"].alias("ax"), a["lat"].alias("ay"), b["lon"].alias("bx"), b["lat"].alias("by")),
    )


def with_region(rois: DataFrame) -> DataFrame:
    """``poi, ring`` with the bounding box and a key ``region`` of name and ring."""
    return rois.select("poi", "ring", ring_box(F.col("ring")).alias("box"), F.xxhash64("poi", "ring").alias("region"))


def with_slabs(regions: DataFrame, axis: str) -> DataFrame:
    """Add the slabs of each ring along ``lat`` or ``lon``: their start, width and number."""
    low, high = F.col(f"box.{axis}_lo"), F.col(f"box.{axis}_hi")
    a, b = ("ay", "by") if axis == "lat" else ("ax", "bx")
    run = F.aggregate(edges(F.col("ring")), F.lit(0.0), lambda total, e: total + F.abs(e[b] - e[a]))
    n = (F.size("ring") - 1).cast("double")
    slabs = F.when(high > low, F.greatest(F.lit(1.0), F.least(n, F.floor(n * 3.0 * (high - low) / run)))).otherwise(1.0)
    sized = regions.withColumn("slabs", slabs.cast("bigint"))
    return sized.withColumns({"slab_lo": low, "slab_width": F.when(high > low, (high - low) / F.col("slabs")).otherwise(1.0)})


def slab_of(value: Column) -> Column:
    """Slab of a coordinate; what lies beyond the ring falls into the outermost slabs."""
    at = F.floor((value - F.col("slab_lo")) / F.col("slab_width"))
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.col("slabs") - 1, at))


def slab_edges(regions: DataFrame, axis: str, margin: float = 0.0) -> DataFrame:
    """``region, slab, edges``: the edges that reach into each slab, or come as near as ``margin``."""
    a, b = ("ay", "by") if axis == "lat" else ("ax", "bx")
    each = regions.dropDuplicates(["region"]).select("region", *SLAB, F.explode(edges(F.col("ring"))).alias("e"))
    first, last = slab_of(F.least(f"e.{a}", f"e.{b}") - margin), slab_of(F.greatest(f"e.{a}", f"e.{b}") + margin)
    listed = each.select("region", "e", F.explode(F.sequence(first, last)).alias("slab"))
    return listed.groupBy("region", "slab").agg(F.collect_list("e").alias("edges"))


def join_slabs(rows: DataFrame, slabs: DataFrame, salt_by: list[str], broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Attach the edges of the slab of each row by ``region, slab``; ``slabs`` is a written table."""
    size = slabs.agg(F.coalesce(F.sum(1 + F.size("edges") / EDGES_PER_ROW), F.lit(0.0))).first()[0]
    return lookup_join(rows, slabs, ["region", "slab"], salt_by, int(size), broadcast_rows, hot_rows)


def edges_contain(found: Column, lon: Column, lat: Column, margin: bool = False) -> Column:
    """Even-odd test of a point by the edges of its latitude slab; the border counts as inside.

    The border is as in :func:`ring_contains`; with ``margin`` a point may also lie
    ``BORDER`` degrees beyond an end of an edge.
    """
    state = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("edge"))

    def step(acc: Column, e: Column) -> Column:
        dx, dy, px, py = e["bx"] - e["ax"], e["by"] - e["ay"], lon - e["ax"], lat - e["ay"]
        turn, square = dx * py - dy * px, dx * dx + dy * dy
        if margin:
            along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / F.greatest(square, F.lit(1e-300))))
            off_x, off_y = px - along * dx, py - along * dy
            near = off_x * off_x + off_y * off_y <= BORDER * BORDER
        else:
            near = (
                (F.abs(turn) <= F.sqrt(square) * BORDER)
                & lon.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"]))
                & lat.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
            )
        crosses = ((e["ay"] > lat) != (e["by"] > lat)) & F.when(dy > 0, turn > 0).otherwise(turn < 0)
        return F.struct((acc["odd"] != crosses).alias("odd"), (acc["edge"] | near).alias("edge"))

    return F.aggregate(found, state, step, lambda acc: acc["odd"] | acc["edge"])


# Containment.

PAIR = ["inner_region", "region"]
EDGE = ["ax", "ay", "bx", "by"]


def _outside(points: DataFrame, slabs: DataFrame, limits: dict) -> DataFrame:
    """Pairs that have a point ``x, y`` outside the container."""
    placed = points.withColumn("slab", slab_of(F.col("y")))
    tested = join_slabs(placed, slabs, ["x", "y"], **limits)
    return tested.filter(~edges_contain(F.col("edges"), F.col("x"), F.col("y"), margin=True)).select(*PAIR).distinct()


def _cuts() -> Column:
    """Places along an inner edge, from 0 to 1, where it meets the edges of a slab or passes their corners."""
    ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")

    def at(e: Column) -> Column:
        dx, dy, rx, ry = e["bx"] - e["ax"], e["by"] - e["ay"], e["ax"] - F.col("ax"), e["ay"] - F.col("ay")
        return F.array(F.try_divide(rx * dy - ry * dx, ex * dy - ey * dx), F.try_divide(rx * ex + ry * ey, ex * ex + ey * ey))

    low, high = (lambda p, q: F.least(p, q) - BORDER), (lambda p, q: F.greatest(p, q) + BORDER)
    meets = lambda e: (
        (low(e["ax"], e["bx"]) <= high(F.col("ax"), F.col("bx"))) & (low(F.col("ax"), F.col("bx")) <= high(e["ax"], e["bx"]))
        & (low(e["ay"], e["by"]) <= high(F.col("ay"), F.col("by"))) & (low(F.col("ay"), F.col("by")) <= high(e["ay"], e["by"]))
    )
    return F.filter(F.flatten(F.transform(F.filter("edges", meets), at)), lambda t: (t > 0) & (t < 1))


def within(pairs: DataFrame, inner: DataFrame, container: DataFrame, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The pairs ``inner_region, region`` in which no part of the inner ring leaves the container.

    First every corner is tested. Then the inner edges are cut where they meet an edge of
    the container; between two cuts an edge stays on one side, so the middles of the
    pieces tell. Edges meet by the slabs they share, and every test sees one slab.
    """
    limits = {"broadcast_rows": broadcast_rows, "hot_rows": hot_rows}
    slabs = stage(slab_edges(container, "lat", BORDER), "slabs")
    lines = inner.dropDuplicates(["region"]).select(F.col("region").alias("inner_region"), F.explode(edges(F.col("ring"))).alias("e"))
    lines = lines.select("inner_region", *[F.col(f"e.{c}").alias(c) for c in EDGE])
    shape = container.dropDuplicates(["region"]).select("region", *SLAB)

    def walk(kept: DataFrame) -> DataFrame:
        shaped = lookup_join(kept.select(*PAIR).distinct(), shape, ["region"], ["inner_region"], **limits)
        return salted_join(lines, shaped, ["inner_region"], EDGE, hot_rows=hot_rows)

    corners = walk(pairs).withColumnsRenamed({"ax": "x", "ay": "y"}).drop("bx", "by")
    left = stage(pairs.join(_outside(corners, slabs, limits), PAIR, "left_anti"), "pairs")
    first, last = slab_of(F.least("ay", "by") - BORDER), slab_of(F.greatest("ay", "by") + BORDER)
    spans = walk(left).withColumn("slab", F.explode(F.sequence(first, last)))
    cut = join_slabs(spans, slabs, EDGE, **limits).groupBy(*PAIR, *EDGE, *SLAB).agg(F.flatten(F.collect_list(_cuts())).alias("t"))
    t = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), "t")))
    middle = F.zip_with(F.slice("t", F.lit(1), F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1), lambda a, b: (a + b) / 2)
    pieces = stage(cut.withColumn("t", t).select(*PAIR, *EDGE, *SLAB, F.explode(middle).alias("m")), "pieces")
    along = lambda a, b: F.col(a) + F.col("m") * (F.col(b) - F.col(a))
    middles = pieces.select(*PAIR, *SLAB, along("ax", "bx").alias("x"), along("ay", "by").alias("y"))
    return left.join(_outside(middles, slabs, limits), PAIR, "left_anti")


# Overlap.


def _shared(e: Column, found: Column, low: Column, high: Column, base: Column) -> Column:
    """Signed areas under both ``e`` and each of the edges ``found``, down to ``base``, between the longitudes ``low`` and ``high``.

    Step by step, so that nothing is worked out twice; edges without common longitudes fall out first.
    """

    def span(f: Column) -> Column:
        x0 = F.greatest(low, F.least(e["ax"], e["bx"]), F.least(f["ax"], f["bx"]))
        x1 = F.least(high, F.greatest(e["ax"], e["bx"]), F.greatest(f["ax"], f["bx"]))
        return F.struct(f.alias("f"), x0.alias("x0"), x1.alias("x1"))

    def heights(s: Column) -> Column:
        f = s["f"]
        at = lambda g, x: (g["ay"] - base) + (x - g["ax"]) * F.try_divide(g["by"] - g["ay"], g["bx"] - g["ax"])
        return F.struct(
            (F.signum(e["bx"] - e["ax"]) * F.signum(f["bx"] - f["ax"]) * (s["x1"] - s["x0"])).alias("width"),
            *[at(g, s[x]).alias(name) for name, g, x in (("e0", e, "x0"), ("e1", e, "x1"), ("f0", f, "x0"), ("f1", f, "x1"))],
        )

    def area(h: Column) -> Column:
        d0, d1 = h["e0"] - h["f0"], h["e1"] - h["f1"]
        m0, m1 = F.least(h["e0"], h["f0"]), F.least(h["e1"], h["f1"])
        share = F.try_divide(d0, d0 - d1)
        middle = h["e0"] + share * (h["e1"] - h["e0"])
        mean = F.when(d0 * d1 < 0, (share * (m0 + middle) + (1.0 - share) * (middle + m1)) / 2.0).otherwise((m0 + m1) / 2.0)
        return h["width"] * mean

    spans = F.filter(F.transform(found, span), lambda s: s["x1"] > s["x0"])
    return F.transform(F.transform(spans, heights), area)


def _summed(areas: Column) -> Column:
    """Sum of signed areas and of their sizes as ``struct<area, size>``."""
    start = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("size"))
    return F.aggregate(areas, start, lambda acc, x: F.struct((acc["area"] + x).alias("area"), (acc["size"] + F.abs(x)).alias("size")))


def _settled(area: Column, size: Column) -> Column:
    return F.when(F.abs(area) > size * ROUNDING, F.abs(area)).otherwise(F.lit(0.0))


def whole_overlap(ring: Column, other: Column, base: Column) -> Column:
    """Common area of two small rings, from all pairs of their edges."""
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    total = _summed(F.flatten(F.transform(edges(ring), lambda e: _shared(e, edges(other), low, high, base))))
    return _settled(total["area"], total["size"])


def overlap(pairs: DataFrame, left: DataFrame, right: DataFrame, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``region, other_region, area`` of pairs of rings of any size, in square degrees.

    The area under both of two rings is the sum, over all pairs of their edges, of the
    signed area under both edges. Only edges that share longitudes count; they meet by
    the longitude slabs of the right ring.
    """
    limits = {"broadcast_rows": broadcast_rows, "hot_rows": hot_rows}
    keys = pairs.select("region", "other_region").distinct()
    shaped = with_slabs(right.dropDuplicates(["region"]), "lon")
    slabs = stage(slab_edges(shaped, "lon"), "slabs")
    shape = shaped.select(F.col("region").alias("other_region"), *SLAB, F.col("box.lat_lo").alias("other_lo"))
    lines = left.dropDuplicates(["region"]).select("region", F.col("box.lat_lo").alias("lat_lo"), F.explode(edges(F.col("ring"))).alias("e"))
    known = lookup_join(keys, shape, ["other_region"], ["region"], **limits)
    walk = salted_join(lines, known, ["region"], ["e"], hot_rows=hot_rows)
    first, last = slab_of(F.least("e.ax", "e.bx")), slab_of(F.greatest("e.ax", "e.bx"))
    walk = walk.withColumn("slab", F.explode(F.sequence(first, last))).withColumnsRenamed({"region": "own", "other_region": "region"})
    met = join_slabs(walk, slabs, ["e"], **limits)
    # The outermost slabs reach to infinity: there is no edge of the right ring beyond them.
    low = F.when(F.col("slab") == 0, F.lit(float("-inf"))).otherwise(F.col("slab_lo") + F.col("slab") * F.col("slab_width"))
    high = F.when(F.col("slab") == F.col("slabs") - 1, F.lit(float("inf"))).otherwise(F.col("slab_lo") + (F.col("slab") + 1) * F.col("slab_width"))
    met = met.select("own", "region", "e", "edges", low.alias("low"), high.alias("high"), F.least("lat_lo", "other_lo").alias("base"))

    parts = met.select("own", "region", _summed(_shared(F.col("e"), F.col("edges"), F.col("low"), F.col("high"), F.col("base"))).alias("part"))
    total = parts.groupBy("own", "region").agg(F.sum("part.area").alias("area"), F.sum("part.size").alias("size"))
    return total.select(F.col("own").alias("region"), F.col("region").alias("other_region"), _settled(F.col("area"), F.col("size")).alias("area"))

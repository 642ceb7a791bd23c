"""Spherical distance, unit conversion and ring expressions.

A ring is ``array<struct<lon double, lat double>>``, closed (first = last).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0087714
KM2_PER_SQUARE_DEGREE = 12365.1613
BORDER = 1e-12
RING_TYPE = "array<struct<lon:double,lat:double>>"


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in metres, to the nearest micrometre.

    The rounding makes equal distances compare equal whichever of the two points
    comes first, which the radius comparisons of the clustering rely on.
    """
    half_lat = F.sin(F.radians(lat1 - lat2) * 0.5)
    half_lon = F.sin(F.radians(lon1 - lon2) * 0.5)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    metres = F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (2.0 * EARTH_RADIUS_KM * 1000.0)
    return F.floor(metres * 1000000.0 + 0.5) / 1000000.0


def degree_to_km(degrees: Column) -> Column:
    """Length in kilometres of an arc given in degrees."""
    return F.radians(degrees) * EARTH_RADIUS_KM


def degree_to_m(degrees: Column) -> Column:
    """Length in metres of an arc given in degrees."""
    return F.radians(degrees) * (EARTH_RADIUS_KM * 1000.0)


def m_to_degree(metres: Column) -> Column:
    """Arc in degrees of a length in metres."""
    return F.degrees(metres / (EARTH_RADIUS_KM * 1000.0))


def box_distance_bounds(a: dict[str, Column], b: dict[str, Column]) -> tuple[Column, Column]:
    """Lower and upper bound in metres of the distance of two latitude/longitude boxes.

    Each box maps ``lat_lo, lat_hi, lon_lo, lon_hi`` to columns. Both bounds come
    from the haversine sum with each factor at its extreme, so no pair of points
    of the boxes lies outside them; a millimetre is added for rounding. Boxes
    that face each other across the 180th meridian are handled by taking the
    shorter way round.
    """
    zero, half_turn = F.lit(0.0), F.lit(180.0)
    lat_gap = F.greatest(zero, a["lat_lo"] - b["lat_hi"], b["lat_lo"] - a["lat_hi"])
    lat_span = F.greatest(a["lat_hi"], b["lat_hi"]) - F.least(a["lat_lo"], b["lat_lo"])
    gap = F.greatest(zero, a["lon_lo"] - b["lon_hi"], b["lon_lo"] - a["lon_hi"])
    span = F.greatest(a["lon_hi"], b["lon_hi"]) - F.least(a["lon_lo"], b["lon_lo"])
    lon_gap = F.least(gap, F.greatest(zero, F.lit(360.0) - span))
    lon_span = F.least(half_turn, F.when(gap > 180.0, F.lit(360.0) - gap).otherwise(span))

    def cos_range(box: dict[str, Column]) -> tuple[Column, Column]:
        widest = F.greatest(F.abs(box["lat_lo"]), F.abs(box["lat_hi"]))
        narrowest = F.when(
            (box["lat_lo"] <= 0) & (box["lat_hi"] >= 0), zero
        ).otherwise(F.least(F.abs(box["lat_lo"]), F.abs(box["lat_hi"])))
        return F.cos(F.radians(widest)), F.cos(F.radians(narrowest))

    def arc(lat: Column, lon: Column, cos_product: Column) -> Column:
        s_lat = F.sin(F.radians(lat) * 0.5)
        s_lon = F.sin(F.radians(lon) * 0.5)
        h = s_lat * s_lat + cos_product * s_lon * s_lon
        return F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (2.0 * EARTH_RADIUS_KM * 1000.0)

    a_low, a_high = cos_range(a)
    b_low, b_high = cos_range(b)
    lower = arc(lat_gap, lon_gap, a_low * b_low) - 0.001
    upper = arc(lat_span, lon_span, a_high * b_high) + 0.001
    return lower, upper


def closed(ring: Column) -> Column:
    """The ring with its first vertex repeated at the end when it is not there yet."""
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    same = (first["lon"] == last["lon"]) & (first["lat"] == last["lat"])
    return F.when(F.size(ring) == 0, ring).when(same, ring).otherwise(F.concat(ring, F.array(first)))


def rectangle(lon_lo: Column, lat_lo: Column, lon_hi: Column, lat_hi: Column) -> Column:
    """Counter-clockwise ring of a box."""
    corners = [(lon_lo, lat_lo), (lon_hi, lat_lo), (lon_hi, lat_hi), (lon_lo, lat_hi), (lon_lo, lat_lo)]
    return F.array(*[F.struct(x.alias("lon"), y.alias("lat")) for x, y in corners])


def ring_box(ring: Column) -> Column:
    """Bounding box of a ring as ``struct<lon_lo, lon_hi, lat_lo, lat_hi>``."""
    lons = F.transform(ring, lambda v: v["lon"])
    lats = F.transform(ring, lambda v: v["lat"])
    return F.struct(
        F.array_min(lons).alias("lon_lo"),
        F.array_max(lons).alias("lon_hi"),
        F.array_min(lats).alias("lat_lo"),
        F.array_max(lats).alias("lat_hi"),
    )


def signed_area(ring: Column) -> Column:
    """Shoelace area in square degrees, positive when counter-clockwise.

    Vertices are taken relative to the first one, which keeps small rings exact.
    """
    x0, y0 = ring[0]["lon"], ring[0]["lat"]
    twice = F.aggregate(
        F.sequence(F.lit(2), F.size(ring)),
        F.lit(0.0),
        lambda acc, i: acc
        + (F.element_at(ring, i - 1)["lon"] - x0) * (F.element_at(ring, i)["lat"] - y0)
        - (F.element_at(ring, i)["lon"] - x0) * (F.element_at(ring, i - 1)["lat"] - y0),
    )
    return F.when(F.size(ring) < 4, F.lit(0.0)).otherwise(twice / 2.0)


def planar_area(ring: Column) -> Column:
    """Area in square degrees."""
    return F.abs(signed_area(ring))


def area_km2(ring: Column, planar: bool = False) -> Column:
    """Area in square kilometres.

    By default the square degrees are scaled by the share that a box at this
    latitude keeps of a box at the equator; ``planar`` leaves that factor out.
    """
    area = planar_area(ring) * KM2_PER_SQUARE_DEGREE
    if planar:
        return area
    box = ring_box(ring)
    height = F.radians(box["lat_hi"]) - F.radians(box["lat_lo"])
    factor = (F.sin(F.radians(box["lat_hi"])) - F.sin(F.radians(box["lat_lo"]))) / height
    return F.when(height > 0, area * factor).otherwise(F.lit(0.0))


def ring_contains(ring: Column, lon: Column, lat: Column) -> Column:
    """Even-odd test of a point against any simple ring; the border counts as inside.

    A point within ``BORDER`` degrees of an edge is on the border: decimal
    coordinates on a line are rarely exactly on it in binary.
    """
    state = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("edge"))

    def step(acc: Column, i: Column) -> Column:
        a, b = F.element_at(ring, i - 1), F.element_at(ring, i)
        turn = (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])
        length = F.sqrt((b["lon"] - a["lon"]) * (b["lon"] - a["lon"]) + (b["lat"] - a["lat"]) * (b["lat"] - a["lat"]))
        on_edge = (
            (F.abs(turn) <= length * BORDER)
            & lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"]))
            & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))
        )
        upward = b["lat"] > a["lat"]
        crosses = ((a["lat"] > lat) != (b["lat"] > lat)) & F.when(upward, turn > 0).otherwise(turn < 0)
        return F.struct(
            (acc["odd"] != crosses).alias("odd"), (acc["edge"] | on_edge).alias("edge")
        )

    return F.aggregate(
        F.sequence(F.lit(2), F.size(ring)), state, step, lambda acc: acc["odd"] | acc["edge"]
    )


def ring_wkt(ring: Column) -> Column:
    """Well-known text of the ring, for exchange with other tools."""
    pairs = F.transform(ring, lambda v: F.concat_ws(" ", v["lon"].cast("string"), v["lat"].cast("string")))
    return F.concat(F.lit("POLYGON(("), F.array_join(pairs, ","), F.lit("))"))


def ring_from_wkt(text: Column) -> Column:
    """Outer ring of a ``POLYGON`` text."""
    inner = F.regexp_extract(text, r"\(\(([^)]*)\)", 1)
    return F.transform(
        F.split(F.trim(inner), r"\s*,\s*"),
        lambda pair: F.struct(
            F.element_at(F.split(pair, r"\s+"), 1).cast("double").alias("lon"),
            F.element_at(F.split(pair, r"\s+"), 2).cast("double").alias("lat"),
        ),
    )

"""Ring tests, the sphere grid and the spatial joins."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.functions import geo, grid
from footfall.operators import spatial

SQUARE = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
SHIFTED = [(0.5, 0.0), (1.5, 0.0), (1.5, 1.0), (0.5, 1.0), (0.5, 0.0)]
ELL = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
REGION = "poi string, ring array<struct<lon double, lat double>>"


def regions(spark, **rings):
    return spark.createDataFrame([(k, v) for k, v in rings.items()], REGION)


def test_quality_of_half_a_square(spark):
    row = spatial.roi_quality(regions(spark, a=SQUARE, gone=ELL), regions(spark, a=SHIFTED)).orderBy("poi").collect()
    assert [round(row[0][c], 12) for c in ("tp", "fp", "fn", "precision", "recall", "f1")] == [0.5] * 6
    assert (row[1].poi, row[1].matched, row[1].f1) == ("gone", False, None)


def test_overlap_with_concave_subject(spark):
    shared = spatial.roi_overlap(regions(spark, ell=ELL), regions(spark, box=[(0.5, 0.5), (2.5, 0.5), (2.5, 2.5), (0.5, 2.5), (0.5, 0.5)]))
    assert shared.first().area == pytest.approx(1.5 * 0.5 + 0.5 * 1.0)
    reverse = spatial.roi_overlap(regions(spark, ell=ELL[::-1]), regions(spark, box=SQUARE[::-1]))
    assert reverse.first().area == pytest.approx(1.0)


def test_overlap_finds_all_pairs_of_any_size(spark):
    rng = np.random.default_rng(5)
    boxes = []
    for i in range(60):
        x, y, w = rng.uniform(0, 3), rng.uniform(0, 3), 10 ** rng.uniform(-4, 0)
        boxes.append((f"r{i}", [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]))
    left, right = (spark.createDataFrame([(n, [(float(a), float(b)) for a, b in r]) for n, r in part], REGION) for part in (boxes[:30], boxes[30:]))
    found = {(r.poi, r.other_poi) for r in spatial.roi_overlap(left, right).collect()}
    want = set()
    for n, a in boxes[:30]:
        for m, b in boxes[30:]:
            if min(a[2][0], b[2][0]) > max(a[0][0], b[0][0]) and min(a[2][1], b[2][1]) > max(a[0][1], b[0][1]):
                want.add((n, m))
    assert found == want and want


def test_point_in_ring_with_border(spark):
    cases = {(0.5, 0.5): True, (1.0, 0.5): True, (0.0, 0.0): True, (1.5, 1.5): False, (1.0, 1.5): True, (2.0, 2.0): False, (1.5, 1.0): True}
    posts = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(cases)], "post_id long, latitude double, longitude double")
    hits = {r.post_id for r in spatial.point_in_roi(posts, regions(spark, ell=ELL)).collect()}
    assert hits == {i for i, inside in enumerate(cases.values()) if inside}


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0, "hot_rows": 10}])
def test_point_in_roi_equals_testing_every_pair(spark, limits):
    rng = np.random.default_rng(2)
    points = [(i, float(y), float(x)) for i, (y, x) in enumerate(rng.uniform(0, 0.2, (400, 2)))]
    points += [(400 + i, 0.1, 0.1) for i in range(50)]
    posts = spark.createDataFrame(points, "post_id long, latitude double, longitude double")
    rois = []
    for i in range(12):
        x, y, r = *rng.uniform(0, 0.2, 2), 10 ** rng.uniform(-3, -1)
        angle = np.linspace(0, 2 * np.pi, 9)
        rois.append((f"r{i}", [(float(x + r * np.cos(a)), float(y + r * np.sin(a))) for a in angle[:-1]]))
        rois[-1][1].append(rois[-1][1][0])
    frame = spark.createDataFrame(rois, REGION)
    got = sorted((r.post_id, r.poi) for r in spatial.point_in_roi(posts, frame, **limits).collect())
    every = posts.crossJoin(frame).filter(geo.ring_contains(F.col("ring"), F.col("longitude"), F.col("latitude")))
    assert got == sorted((r.post_id, r.poi) for r in every.collect()) and got


def test_within(spark):
    inner = regions(spark, small=[(0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8), (0.2, 0.2)], same=SQUARE, half=SHIFTED,
                    bridge=[(0.5, 1.8), (1.8, 0.5), (1.9, 0.5), (0.5, 1.8)])
    pairs = {(r.inner_poi, r.poi) for r in spatial.roi_within_roi(inner, regions(spark, box=SQUARE, ell=ELL)).collect()}
    assert pairs == {("small", "box"), ("same", "box"), ("small", "ell"), ("same", "ell"), ("half", "ell")}


def test_area_of_a_degree(spark):
    row = spatial.roi_area(regions(spark, a=SQUARE), planar=True).first()
    assert row.area_km2 == pytest.approx(12365.1613)
    assert spatial.roi_area(regions(spark, a=SQUARE)).first().area_km2 < row.area_km2


def test_wkt_round_trip(spark):
    text = regions(spark, a=ELL).select(geo.ring_wkt(F.col("ring")).alias("t"))
    ring = text.select(geo.ring_from_wkt(F.col("t")).alias("ring")).first().ring
    assert [(v.lon, v.lat) for v in ring] == ELL


@pytest.mark.parametrize("radius_m", [50.0, 20000.0, 3000000.0])
def test_sphere_cover_misses_nothing(spark, radius_m):
    rng = np.random.default_rng(9)
    lat = np.concatenate([rng.uniform(-90, 90, 60), rng.uniform(89.5, 90, 20), rng.uniform(-90, -89.5, 20)])
    lon = np.concatenate([rng.uniform(-180, 180, 50), rng.choice([-180.0, 179.9999, 180.0, -179.9999], 50)])
    near = radius_m / 111195.0
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))]
    points += [(100 + i, float(np.clip(a + rng.uniform(-near, near), -90, 90)), float((b + rng.uniform(-near, near) + 540) % 360 - 180)) for i, a, b in points[:100]]
    frame = spark.createDataFrame(points, "id long, lat double, lon double")
    side = geo.m_to_degree(F.lit(radius_m))
    cover = grid.explode_sphere_cover(frame, side, side).select(F.col("id").alias("q"), "row", "col")
    assert cover.count() == cover.distinct().count()
    pairs = grid.with_sphere_cell(frame, side).join(cover, ["row", "col"]).select("q", "id")
    other = frame.select(F.col("id").alias("q"), F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"))
    true = frame.crossJoin(other).filter(geo.distance_m(F.col("lat"), F.col("lon"), F.col("q_lat"), F.col("q_lon")) <= radius_m)
    true = true.select("q", "id")
    assert true.count() > 200
    assert true.join(pairs, ["q", "id"], "left_anti").isEmpty()


def test_box_bounds_enclose_distances(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        boxes = []
        for _ in "ab":
            y, x, h, w = rng.uniform(-80, 80), rng.uniform(-180, 170), rng.uniform(0, 5), rng.uniform(0, 10)
            boxes += [y, y + h, x, x + w]
        t = rng.uniform(0, 1, 4)
        rows.append((*map(float, boxes), float(boxes[0] + t[0] * (boxes[1] - boxes[0])), float(boxes[2] + t[1] * (boxes[3] - boxes[2])),
                     float(boxes[4] + t[2] * (boxes[5] - boxes[4])), float(boxes[6] + t[3] * (boxes[7] - boxes[6]))))
    names = [f"{e}_{c}" for e in "ab" for c in ("lat_lo", "lat_hi", "lon_lo", "lon_hi")] + ["pa", "oa", "pb", "ob"]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    box = lambda e: {c: F.col(f"{e}_{c}") for c in ("lat_lo", "lat_hi", "lon_lo", "lon_hi")}
    lower, upper = geo.box_distance_bounds(box("a"), box("b"))
    d = geo.distance_m(F.col("pa"), F.col("oa"), F.col("pb"), F.col("ob"))
    assert frame.filter((d < lower) | (d > upper)).isEmpty()


def test_region_in_the_notch_is_not_within(spark):
    notched = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 2.0), (0.0, 4.0), (0.0, 0.0)]
    wedge = [(0.0, 4.0), (2.0, 2.0), (4.0, 4.0), (0.0, 4.0)]
    low = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 2.0), (0.0, 0.0)]
    across = [(0.5, 3.0), (3.5, 3.0), (3.5, 0.5), (0.5, 0.5), (0.5, 3.0)]
    rings = regions(spark, wedge=wedge, low=low, across=across, itself=notched)
    found = {r.inner_poi for r in spatial.roi_within_roi(rings, regions(spark, notched=notched)).collect()}
    assert found == {"low", "itself"}


def test_concave_on_both_sides(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]
    turned = [(2.0 - x, 2.0 - y) for x, y in ELL]
    shared = spatial.roi_overlap(regions(spark, a=square, b=ELL), regions(spark, ell=ELL, turned=turned, back=ELL[::-1]))
    got = {(r.poi, r.other_poi): round(r.area, 12) for r in shared.collect()}
    assert got == {("a", "ell"): 3.0, ("a", "turned"): 3.0, ("a", "back"): 3.0, ("b", "ell"): 3.0, ("b", "turned"): 2.0, ("b", "back"): 3.0}
    row = spatial.roi_quality(regions(spark, a=square), regions(spark, a=ELL)).first()
    assert (round(row.precision, 12), round(row.recall, 12), round(row.f1, 12)) == (1.0, 0.75, round(6 / 7, 12))


def test_overlap_candidates_stay_few(spark):
    """One large region beside many small ones does not make the small ones meet."""
    box = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    small = {f"s{i}": box(0.1 * (i % 40), 0.1 * (i // 40), 0.001) for i in range(1000)}
    found = spatial.overlap_candidates(regions(spark, big=box(0.0, 0.0, 4.0), **small), regions(spark, **small))
    assert found.count() == 2000
    met = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in met and found.filter("poi <> 'big' AND poi <> other_poi").count() == 0

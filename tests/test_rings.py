"""Large rings: slabs of edges against whole rings and against known shapes."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.operators import rings, spatial

REGION = "poi string, ring array<struct<lon double, lat double>>"


def _round(n, x=12.0, y=41.0, r=1.0, waves=0, depth=0.0):
    angle = 2 * np.pi * np.arange(n) / n
    radius = r * (1 + depth * np.cos(waves * angle))
    ring = np.column_stack([x + radius * np.cos(angle), y + radius * np.sin(angle)])
    return np.vstack([ring, ring[:1]])


def _comb(teeth, x=0.0, y=0.0, step=0.01, height=1.0):
    """A back and ``teeth`` teeth: every latitude within the teeth crosses all of them."""
    top = [(x + step * (2 * k + i), y + (height if i in (0, 1) else 0.1)) for k in range(teeth) for i in (0, 1)]
    path = [(x, y)]
    for k in range(teeth):
        path += [(x + step * 2 * k, y + height), (x + step * (2 * k + 1), y + height)]
        path += [(x + step * (2 * k + 1), y + 0.1), (x + step * (2 * k + 2), y + 0.1)] if k < teeth - 1 else [(x + step * (2 * k + 1), y)]
    assert top
    return np.array([*path, (x, y)])


def _frame(spark, **shapes):
    rows = [(name, [(float(a), float(b)) for a, b in ring]) for name, ring in shapes.items()]
    return spark.createDataFrame(rows, REGION)


def _holds(ring, points):
    a, b = ring[:-1], ring[1:]
    x, y = points[:, :1], points[:, 1:]
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
    return (spans & (x < cut)).sum(axis=1) % 2 == 1


@pytest.mark.parametrize("shape", ["round", "waves", "comb"])
def test_slabs_list_few_edges(spark, shape):
    ring = {"round": _round(100_000), "waves": _round(20_000, waves=60, depth=0.3), "comb": _comb(2000)}[shape]
    regions = rings.with_slabs(rings.with_region(_frame(spark, a=ring)), "lat")
    slabs = rings.slab_edges(regions, "lat").select("slab", F.size("edges").alias("n"))
    listed, largest, mean = slabs.agg(F.sum("n"), F.max("n"), F.avg("n")).first()
    assert listed <= 4 * len(ring) + 100
    if shape == "round":
        assert mean < 5


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0, "hot_rows": 200}])
def test_points_in_large_rings(spark, limits):
    shapes = {"wavy": _round(20_000, waves=40, depth=0.2), "comb": _comb(300, x=11.0, y=41.0, step=0.003), "box": _round(4, 12.2, 41.1, 0.3)}
    rng = np.random.default_rng(1)
    points = np.round(rng.uniform([10.5, 39.5], [13.5, 42.5], (3000, 2)), 9)
    posts = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "post_id long, longitude double, latitude double")
    got = {(r.post_id, r.poi) for r in spatial.point_in_roi(posts, _frame(spark, **shapes), **limits).collect()}
    want = {(int(k), name) for name, ring in shapes.items() for k in np.flatnonzero(_holds(ring, points))}
    assert got == want and len({name for _, name in want}) == 3


def test_corners_of_a_large_ring_are_inside(spark):
    ring = np.round(_round(5000), 7)
    posts = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(ring[:-1])], "post_id long, longitude double, latitude double")
    assert spatial.point_in_roi(posts, _frame(spark, a=ring)).count() == 5000


def test_large_rings_within(spark):
    outer = _round(50_000, waves=30, depth=0.1)
    dented = _round(50_000, r=0.8)
    spike = dented.copy()
    spike[20_000] = [10.0, 41.0]
    crossing = _round(50_000, waves=31, depth=0.1)
    inner = _frame(spark, dented=dented, spike=spike, crossing=crossing, itself=outer, far=_round(1000, 12.95, 41.0, 0.2))
    got = {(r.inner_poi, r.poi) for r in spatial.roi_within_roi(inner, _frame(spark, outer=outer)).collect()}
    assert got == {("dented", "outer"), ("itself", "outer")}


def test_edge_across_a_notch_is_not_within(spark):
    """All corners lie inside, only the middles of edges do not."""
    comb = _comb(200)
    bar = np.array([(0.005, 0.5), (0.005 + 0.02 * 150, 0.5), (0.005 + 0.02 * 150, 0.6), (0.005, 0.6), (0.005, 0.5)])
    low = np.array([(0.005, 0.02), (3.0, 0.02), (3.0, 0.08), (0.005, 0.08), (0.005, 0.02)])
    got = {r.inner_poi for r in spatial.roi_within_roi(_frame(spark, bar=bar, low=low), _frame(spark, comb=comb)).collect()}
    assert got == {"low"}


def test_overlap_of_large_rings(spark):
    n = 10_000
    left = _frame(spark, a=_round(n), wavy=_round(n, waves=50, depth=0.2))
    right = _frame(spark, b=_round(n, x=13.0), same=_round(n, waves=50, depth=0.2)[::-1], small=_round(8, r=0.1))
    got = {(r.poi, r.other_poi): r.area for r in spatial.roi_overlap(left, right).collect()}
    lens = 2 * math.acos(0.5) - 0.5 * math.sqrt(3)
    assert got["a", "b"] == pytest.approx(lens, rel=1e-6)
    assert got["wavy", "same"] == pytest.approx(math.pi * (1 + 0.2**2 / 2), rel=1e-4)
    octagon = 2 * math.sqrt(2) * 0.1**2
    assert got["a", "small"] == pytest.approx(octagon, rel=1e-9) and got["wavy", "small"] == pytest.approx(octagon, rel=1e-9)


@pytest.mark.parametrize("limit", [3, 64])
def test_overlap_by_slabs_equals_whole_rings(spark, monkeypatch, limit):
    monkeypatch.setattr(spatial, "WHOLE_RING", limit)
    rng = np.random.default_rng(7)
    star = lambda n: np.column_stack([
        (r := rng.uniform(0.2, 1.0, n)) * np.cos(a := np.sort(rng.uniform(0, 2 * np.pi, n))), r * np.sin(a)])
    close = lambda ring: np.vstack([ring, ring[:1]])
    left, right = ({f"{side}{k}": close(star(20)) + rng.uniform(-0.5, 0.5, 2) for k in range(5)} for side in "ab")
    got = {(r.poi, r.other_poi): r.area for r in spatial.roi_overlap(_frame(spark, **left), _frame(spark, **right)).collect()}
    x, y = np.meshgrid(np.linspace(-2, 2, 801), np.linspace(-2, 2, 801))
    points, cell = np.column_stack([x.ravel(), y.ravel()]), (4 / 800) ** 2
    for (a, b), area in got.items():
        assert area == pytest.approx((_holds(left[a], points) & _holds(right[b], points)).sum() * cell, abs=0.02)
    boxes = _frame(spark, p=np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]), q=np.array([(1, 0), (2, 0), (2, 1), (1, 1), (1, 0)]), r=np.array([(0.5, 0.5), (3, 0.5), (3, 3), (0.5, 3), (0.5, 0.5)]))
    touching = {(r.poi, r.other_poi): round(r.area, 12) for r in spatial.roi_overlap(boxes, boxes).collect()}
    assert touching == {("p", "p"): 1, ("q", "q"): 1, ("r", "r"): 6.25, ("p", "r"): 0.25, ("r", "p"): 0.25, ("q", "r"): 0.5, ("r", "q"): 0.5}


def test_plans_have_no_python(spark):
    frame = _frame(spark, a=_round(200), b=_round(5))
    for found in (spatial.roi_overlap(frame, frame), spatial.roi_within_roi(frame, frame), spatial.roi_quality(frame, frame)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    quality = {r.poi: r for r in spatial.roi_quality(frame, frame).collect()}
    assert all(round(r.f1, 9) == 1 for r in quality.values())

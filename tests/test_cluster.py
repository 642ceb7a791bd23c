"""Neighbour distances, radii and clusters against brute force, with and without the hot-key paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from footfall.operators import cluster, curves, knn, points, radius, regions
from footfall.session import stage

R = 6371008.7714


def distances(lat, lon):
    la, lo = np.radians(lat), np.radians(lon)
    h = np.sin((la[:, None] - la) / 2) ** 2 + np.cos(la[:, None]) * np.cos(la) * np.sin((lo[:, None] - lo) / 2) ** 2
    return np.floor(2 * R * np.arcsin(np.sqrt(np.minimum(1, h))) * 1e6 + 0.5) / 1e6


@pytest.fixture(scope="module")
def places():
    """One keyword with most points in a dense blob and copies, one sparse, one across
    the 180th meridian, one at a pole, one all on one spot, one with too few places."""
    rng = np.random.default_rng(7)
    rows = []
    blob = np.round(rng.normal(0, 30, (260, 2))) * 1e-5
    halo = rng.uniform(-0.02, 0.02, (60, 2))
    for y, x in np.concatenate([blob, halo]):
        rows.append(("hot", 12.5 + float(x), 41.9 + float(y)))
    rows += [("hot", 12.5, 41.9)] * 40
    rows += [("sparse", 12.0 + float(x), 41.0 + float(y)) for y, x in rng.uniform(0, 1, (60, 2))]
    for y, x in rng.uniform(-0.01, 0.01, (60, 2)):
        lon = 180.0 + float(x)
        rows.append(("wrap", lon - 360.0 if lon > 180 else lon, 10.0 + float(y)))
    rows += [("pole", float(x), 89.99 + float(y)) for y, x in zip(rng.uniform(0, 0.01, 60), rng.uniform(-180, 180, 60))]
    rows += [("spot", 1.0, 1.0)] * 60 + [("few", 2.0, 2.0)] * 3 + [("few", 2.1, 2.0)] * 2
    return rows


@pytest.fixture(scope="module")
def locations(spark, places):
    frame = spark.createDataFrame(places, "term string, lon double, lat double")
    return stage(points.weighted_locations(frame), "test_locations")


def kth_distances(group, k):
    d = distances(group.lat.to_numpy(), group.lon.to_numpy())
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1)
    reached = np.cumsum(group.w.to_numpy()[order], axis=1)
    reached[np.take_along_axis(d, order, 1) == np.inf] = -1
    out = []
    for i in range(len(group)):
        enough = np.flatnonzero(reached[i] >= k)
        out.append(d[i, order[i, enough[0]]] if len(enough) else None)
    return out


@pytest.mark.parametrize("limits", [{}, {"broadcast_rows": 0, "hot_rows": 20}])
def test_knn_is_exact(locations, limits):
    got = {(r.term, r.lon, r.lat): r.dist for r in knn.knn_distance(locations, 4, **limits).collect()}
    seen = 0
    for term, group in locations.toPandas().groupby("term"):
        for row, want in zip(group.itertuples(), kth_distances(group, 4)):
            have = got.get((term, row.lon, row.lat))
            assert (have is None) == (want is None)
            if want is not None:
                assert have == pytest.approx(want, abs=2e-6)
                seen += 1
    assert seen == len(got) > 400


def far(curve, i, threshold):
    last = len(curve) - 1
    span = curve[i] - curve[last]
    return any(
        span > 0 and (curve[j] - curve[last]) / span < 1 - threshold - (j - i) / (last - i) for j in range(i + 1, last)
    )


def first_flat(curve, threshold):
    return next((curve[i] for i in range(len(curve) - 2) if not far(curve, i, threshold)), curve[0])


def first_flat_after_jumps(curve, threshold):
    last = len(curve) - 3
    step = max(1, (len(curve) - 2) // min(100, len(curve)))
    at = reached = 0
    while at <= last and far(curve, at, threshold):
        reached = at
        if at == last:
            break
        at = min(at + step, last)
    return next((curve[i] for i in range(reached, len(curve) - 2) if not far(curve, i, threshold)), curve[0])


@pytest.fixture(scope="module")
def curve_rows():
    rng = np.random.default_rng(3)
    shapes = {
        "bent": np.sort(rng.pareto(1.5, 700))[::-1],
        "line": np.arange(300.0)[::-1],
        "flat": np.ones(10),
        "steps": np.sort(rng.integers(0, 9, 250) ** 2)[::-1].astype(float),
        "arch": 100.0 - np.arange(200.0) ** 2 / 400.0,
    }
    return {k: [float(v) for v in np.sort(values)[::-1]] for k, values in shapes.items()}


@pytest.mark.parametrize("hot_rows", [1_000_000, 15])
def test_radius_rules(spark, curve_rows, hot_rows):
    frame = spark.createDataFrame([(k, v) for k, c in curve_rows.items() for v in c], "term string, dist double")
    hist = stage(curves.histogram(frame, ["term"], "dist"), "test_curve")
    exact = {r.term: r.eps for r in radius.eps_threshold(hist, 0.27, hot_rows).collect()}
    coarse = {r.term: r.eps for r in radius.eps_threshold_coarse(hist, 0.27, hot_rows).collect()}
    for term, values in curve_rows.items():
        assert exact[term] == first_flat(values, 0.27), term
        assert coarse[term] == first_flat_after_jumps(values, 0.27), term


def test_percentile_ends(spark, curve_rows):
    frame = spark.createDataFrame([(k, v) for k, c in curve_rows.items() for v in c], "term string, dist double")
    hist = curves.histogram(frame, ["term"], "dist")
    for share in (0.0, 0.5, 1.0):
        for row in radius.eps_percentile(hist, share).collect():
            values = curve_rows[row.term]
            assert row.eps == values[min(int(len(values) * share), len(values) - 1)]
    with pytest.raises(ValueError):
        radius.eps_percentile(hist, 1.5)


def clusters_by_search(group, eps, min_pts):
    near = distances(group.lat.to_numpy(), group.lon.to_numpy()) <= eps
    core = (near * group.w.to_numpy()).sum(1) - 1 >= min_pts
    spots = list(zip(group.lat, group.lon))
    label = [None] * len(group)
    for i in sorted(range(len(group)), key=spots.__getitem__):
        if core[i] and label[i] is None:
            label[i], todo = spots[i], [i]
            while todo:
                for v in np.flatnonzero(near[todo.pop()] & core):
                    if label[v] is None:
                        label[v] = spots[i]
                        todo.append(v)
    for i in np.flatnonzero(~core):
        label[i] = min((label[v] for v in np.flatnonzero(near[i] & core)), default=None)
    return core, label


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 20, "box_pairs": 2, "group_links": 5}])
def test_dbscan_is_exact(spark, locations, limits):
    eps = {"hot": 25.0, "sparse": 12000.0, "wrap": 400.0, "pole": 300.0, "spot": 1.0, "few": 20000.0}
    radii = spark.createDataFrame(list(eps.items()), "term string, eps double")
    got = {(r.term, r.lon, r.lat): r for r in cluster.dbscan(locations, radii, 4, **limits).collect()}
    assert len(got) == locations.count()
    for term, group in locations.toPandas().groupby("term"):
        core, label = clusters_by_search(group, eps[term], 4)
        for row, is_core, name in zip(group.itertuples(), core, label):
            have = got[term, row.lon, row.lat]
            assert have.core == is_core
            assert (tuple(have.label) if have.label else None) == name


def test_neighbour_counts(spark, locations):
    radii = spark.createDataFrame([("hot", 25.0), ("wrap", 400.0)], "term string, eps double")
    plain = cluster.eps_neighbours(locations, radii).collect()
    salted = cluster.eps_neighbours(locations, radii, box_pairs=2, hot_rows=20).collect()
    assert sorted(plain) == sorted(salted)
    for term, eps in (("hot", 25.0), ("wrap", 400.0)):
        group = locations.filter(F.col("term") == term).toPandas()
        want = (distances(group.lat.to_numpy(), group.lon.to_numpy()) <= eps) @ group.w.to_numpy() - 1
        have = {(r.lon, r.lat): r.neighbours for r in plain if r.term == term}
        assert [have[p] for p in zip(group.lon, group.lat)] == want.tolist()


def test_largest_cluster_needs_more_than_min_pts(spark):
    rows = [("a", float(i), 0.0, (0.0, 0.0)) for i in range(4)] + [("b", float(i), 0.0, (0.0, 0.0)) for i in range(5)]
    rows += [("b", float(i), 9.0, (9.0, 0.0)) for i in range(5)] + [("c", 0.0, 0.0, None)]
    frame = spark.createDataFrame(rows, "term string, lon double, lat double, label struct<lat double, lon double>")
    assert [(r.term, r.label.lat, r.places) for r in cluster.largest_cluster(frame).collect()] == [("b", 0.0, 5)]


def test_hull_holds_all_points_and_drops_lines(spark):
    rng = np.random.default_rng(1)
    rows = [("cloud", float(x), float(y)) for x, y in rng.normal(0, 1, (500, 2))]
    rows += [("line", float(i), float(i)) for i in range(10)] + [("three", 0.0, 0.0), ("three", 1.0, 0.0), ("three", 0.0, 1.0)]
    frame = spark.createDataFrame(rows, "term string, lon double, lat double").repartition(7)
    hulls = {r.term: [(v.lon, v.lat) for v in r.ring] for r in regions.convex_hull(frame).collect()}
    assert set(hulls) == {"cloud"}
    ring = hulls["cloud"]
    assert ring[0] == ring[-1]
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-12 for t, x, y in rows if t == "cloud")


def test_cap_is_a_fixed_sample(spark):
    rows = [("big", i, 0, 0.0, 0.0) for i in range(400)] + [("small", i, 0, 0.0, 0.0) for i in range(30)]
    frame = stage(spark.createDataFrame(rows, "term string, post_id long, pos int, lon double, lat double"), "cap")
    order = lambda i: (((i % 2**31) * 1103515245 + 12345) % 2**31, i)
    want = sorted(range(400), key=order)[:100]
    kept = points.cap_points(frame, 100).collect()
    assert sorted(r.post_id for r in kept if r.term == "big") == sorted(want)
    assert sum(r.term == "small" for r in kept) == 30
    again = points.cap_points(frame.repartition(5), 100).collect()
    assert sorted(kept) == sorted(again)
    old, points.BUCKET_ROWS = points.BUCKET_ROWS, 8
    try:
        assert sorted(points.cap_points(frame, 100).collect()) == sorted(kept)
    finally:
        points.BUCKET_ROWS = old
    assert points.cap_points(frame, None).count() == 430


def test_min_points_is_strict(spark):
    rows = [("fifty", i, 0) for i in range(50)] + [("more", i, 0) for i in range(51)]
    frame = spark.createDataFrame(rows, "term string, post_id long, pos int")
    assert {r.term for r in points.min_points(frame).collect()} == {"more"}
    assert points.term_sizes(frame).agg(F.sum("n")).first()[0] == 51



def test_one_crowded_cell_stays_its_own_affair(spark):
    """Many spread places and one crowded spot: the pairs of every round are linear in the places."""
    rng = np.random.default_rng(8)
    spread, crowd = 20_000, 3_000
    lon = np.concatenate([rng.uniform(12.0, 13.0, spread), 12.5 + rng.uniform(0, 2e-6, crowd)])
    lat = np.concatenate([rng.uniform(41.0, 42.0, spread), 41.5 + rng.uniform(0, 2e-6, crowd)])
    rows = [("t", float(x), float(y), 1) for x, y in zip(lon, lat)]
    places = stage(spark.createDataFrame(rows, "term string, lon double, lat double, w bigint"), "crowd")
    sided = stage(knn._with_side(places), "sided")
    near, far = sided.filter("abs(lon - 12.5) < 3e-6 AND abs(lat - 41.5) < 3e-6"), sided.filter("abs(lon - 12.5) > 0.01")
    assert near.agg(F.max("side")).first()[0] < 1 and far.agg(F.min("side")).first()[0] > 100
    pairs = knn.candidate_pairs(places, sided, 1.0, len(rows), len(rows), 1, 200_000, 1_000_000).count()
    assert pairs < 150 * len(rows)
    got = {(r.lon, r.lat): r.dist for r in knn.knn_distance(places, 4).collect()}
    assert len(got) == len(rows)
    for i in [*range(0, spread, 997), *range(spread, len(rows), 499)]:
        h = np.sin(np.radians(lat - lat[i]) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(lat[i])) * np.sin(np.radians(lon - lon[i]) / 2) ** 2
        d = np.sort(2 * R * np.arcsin(np.sqrt(h)))[4]
        assert got[lon[i], lat[i]] == pytest.approx(d, abs=2e-6)


def test_pairs_are_dealt_by_the_number_of_their_place(spark):
    rows = [("t", 12.0 + i / 1e4, 41.0, 1, 100.0, i) for i in range(20)]
    places = stage(spark.createDataFrame(rows, "term string, lon double, lat double, w bigint, side double, id bigint"), "numbered")
    found = knn._round(places.select("term", "lon", "lat", "w"), places, 1.0, 4, 20, 20, 1, 200_000, 1_000_000)
    assert "hashpartitioning(id#" in found._jdf.queryExecution().executedPlan().toString()
    assert sum(r.dist is not None for r in found.collect()) == 20


def test_boxes_are_split_until_their_pairs_are_few(spark):
    """Places that crowd towards one point ever more: no level of boxes is the last."""
    rng = np.random.default_rng(3)
    nested = [(12.5 + 8.0**-k * 1e-3 * a, 41.5 + 8.0**-k * 1e-3 * b) for k in range(12) for a, b in rng.uniform(0.5, 1, (6, 2))]
    rows = [("t", float(x), float(y), 1) for x, y in nested]
    places = spark.createDataFrame(rows, "term string, lon double, lat double, w bigint")
    radii = spark.createDataFrame([("t", 60.0)], "term string, eps double")
    got = {(r.lon, r.lat): r.neighbours for r in cluster.eps_neighbours(places, radii, box_pairs=2).collect()}
    lon, lat = (np.array([r[i] for r in rows]) for i in (1, 2))
    near = distances(lat, lon) <= 60.0
    assert [got[x, y] for x, y in zip(lon, lat)] == (near.sum(axis=1) - 1).tolist()
    assert 0 < near.sum() < near.size


def test_local_roots_of_chains_and_stars():
    rng = np.random.default_rng(3)
    for links in (40, 400):
        ends = rng.integers(-9, 9 + links // 8, (links, 4))
        chain = np.array([(i, 0, i + 1, 0) for i in range(1000, 1400)])
        frame = pd.DataFrame(np.concatenate([ends, chain[rng.permutation(400)]]), columns=["a_row", "a_col", "b_row", "b_col"])
        frame.insert(0, "term", "t")
        near = {}
        for a, b, c, d in frame.iloc[:, 1:].itertuples(index=False):
            near.setdefault((a, b), set()).add((c, d))
            near.setdefault((c, d), set()).add((a, b))
        want = {}
        for node in sorted(near):
            reach = [] if node in want else [node]
            while reach:
                at = reach.pop()
                if at not in want:
                    want[at] = node
                    reach += near[at]
        got = cluster._local_roots(frame)
        assert {(r.row, r.col): (r.root_row, r.root_col) for r in got.itertuples()} == want and len(got) == len(want)

"""Elbows of histograms against the list form."""

from __future__ import annotations

import numpy as np
import pytest

from footfall.operators import curves, keywords
from footfall.session import stage


def list_elbow(y, gap=None):
    last = len(y) - 1
    best = (0, 0.0, y[0])
    for i in range(1, last + 1):
        if y[0] == y[last]:
            break
        x, scaled = i / last, (y[i] - y[last]) / (y[0] - y[last])
        d = ((1.0 - scaled) - x) * 2.0**0.5 / 2.0
        if d > best[1] and (gap is None or scaled < 1 - gap - x):
            best = (i, d, y[i])
    return best


RNG = np.random.default_rng(11)
CURVES = {
    "straight": [5, 4, 3, 2, 1],
    "steep": [100, 5, 4, 3, 2, 1],
    "constant": [7, 7, 7, 7],
    "random": sorted((int(v) for v in RNG.zipf(1.7, 900)), reverse=True),
    "arch": [10, 10, 10, 9, 0],
}


@pytest.fixture(scope="module")
def histogram(spark):
    frame = spark.createDataFrame([(k, v) for k, c in CURVES.items() for v in c], "name string, y long")
    return stage(curves.histogram(frame, ["name"], "y"), "test_hist")


@pytest.mark.parametrize("hot_rows", [1_000_000, 4])
@pytest.mark.parametrize("gap", [None, 0.27])
def test_elbow_matches_list_form(histogram, gap, hot_rows):
    found = {r.name: r for r in curves.elbow(histogram, ["name"], "y", gap=gap, hot_rows=hot_rows).collect()}
    for name, values in CURVES.items():
        i, d, y = list_elbow(values, gap)
        assert (found[name].i, found[name].y) == (i, y), name
        assert found[name].d == pytest.approx(d)


def test_positions_do_not_depend_on_blocks(histogram):
    plain = curves.with_positions(histogram, ["name"], "y").collect()
    blocks = curves.with_positions(histogram, ["name"], "y", hot_rows=4).collect()
    key = lambda r: (r["name"], r["y"])
    assert [r.asDict() for r in sorted(plain, key=key)] == [r.asDict() for r in sorted(blocks, key=key)]


def test_short_curves(spark):
    hist = spark.createDataFrame([("a", 3, 1), ("a", 1, 1)], "name string, y long, n long")
    row = curves.elbow(hist, ["name"], "y").first()
    assert (row.i, row.d, row.y) == (0.0, 0.0, 0.0)
    with pytest.raises(Exception, match="three points"):
        curves.elbow(hist, ["name"], "y", short="error").collect()


def test_ranks_do_not_depend_on_blocks(spark):
    rows = [(1, c, f"t{i:03}", 1, float(i % 7)) for c in (1, 2) for i in range(60)]
    scores = stage(spark.createDataFrame(rows, "cell_y long, cell_x long, term string, tf long, score double"), "scores")
    plain = keywords.ranked_keywords(scores).select("cell_x", "term", "rank").collect()
    blocks = keywords.ranked_keywords(scores, hot_rows=5).select("cell_x", "term", "rank").collect()
    assert sorted(plain) == sorted(blocks)


def test_bootstrap_of_heavy_places(spark):
    """Places of very many points are sampled without writing out their positions."""
    from footfall.operators import radius

    rows = [("t", 9.0, 10**8), ("t", 5.0, 7), ("t", 2.0, 3), ("t", 1.0, 10**8)]
    curve = spark.createDataFrame(rows, "term string, dist double, n long")
    eps = radius.eps_bootstrap(curve, repetitions=5, samples=200).first().eps
    assert eps in {r[1] for r in rows}

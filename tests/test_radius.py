"""Chord queries in bulk against all pairs, and their cost on a long curve."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest

from footfall.operators import radius

RNG = np.random.default_rng(5)
SHAPES = {
    "spread": lambda k: RNG.random(k) * 100,
    "heavy": lambda k: RNG.pareto(1.2, k),
    "bowed": lambda k: 100 - RNG.pareto(2.0, k) % 100,
}


def curve(values) -> pd.DataFrame:
    values = np.unique(np.asarray(values, float).round(9))[::-1]
    n = RNG.integers(1, 4, len(values))
    start = np.append(0, np.cumsum(n)[:-1])
    return pd.DataFrame({"term": "t", "dist": values, "n": n, "start": start, "total": n.sum(), "y_last": values[-1]})


def all_pairs(rows, threshold):
    """Whether a later point dips below the chord, for every position up to the last but two."""
    last, y_last = int(rows["total"].iloc[0]) - 1, rows["y_last"].iloc[0]
    start, n, y = (rows[c].tolist() for c in ("start", "n", "dist"))
    out = {}
    for k in range(len(rows)):
        for i in range(start[k], min(start[k] + n[k] - 1, last - 2) + 1):
            later = [j for j in range(k + 1, len(rows)) if start[j] < last]
            below = ((y[j] - y_last) / (y[k] - y_last) < 1 - threshold - (start[j] - i) / (last - i) for j in later)
            out[i] = y[k] != y_last and any(below)
    return out


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("threshold", [0.27, 0.05])
def test_flags_match_all_pairs(shape, threshold):
    for size in (1, 2, 3, 4, 5, 17, 64, 90):
        for _ in range(8):
            rows = curve(SHAPES[shape](size))
            want = all_pairs(rows, threshold)
            whole = radius._far_flags(rows, None, threshold)
            assert all(r.far == want[r.i] for r in whole.itertuples())
            assert set(whole.loc[~whole["coarse"], "i"]) == {i for i in rows["start"] if i in want}
            cut = len(rows) // 2
            if cut:  # the first block, which knows the second by its points only
                later = rows[cut:].query("start < total - 1")[["term", "start", "dist"]]
                first = radius._far_flags(rows[:cut], later, threshold)
                assert all(r.far == want[r.i] for r in first.itertuples())


def test_hull_has_no_point_below():
    for shape in SHAPES.values():
        rows = curve(shape(200))
        x, y = rows["start"].to_numpy(float), rows["dist"].to_numpy()
        hull = radius._lower_hull(x, y)
        assert hull[0] == 0 and hull[-1] == len(x) - 1
        assert (np.diff(np.diff(y[hull]) / np.diff(x[hull])) >= 0).all()
        assert (y >= np.interp(x, x[hull], y[hull]) - 1e-9).all()


def test_a_million_points_take_seconds():
    y = 1e6 / (1.0 + np.arange(10**6))
    rows = pd.DataFrame({"term": "t", "dist": y, "n": 1, "start": np.arange(10**6), "total": 10**6, "y_last": y[-1]})
    begin = time.perf_counter()
    flags = radius._far_flags(rows, None, 0.27)
    assert time.perf_counter() - begin < 60
    stop = int(flags.loc[~flags["far"], "i"].min())
    assert 0 < stop < 10**6 - 2 and flags.loc[flags["i"] < stop, "far"].all()

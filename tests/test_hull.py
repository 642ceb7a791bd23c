"""Convex hulls against hulls in whole numbers."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from footfall.operators import regions


def _corners(points):
    """Corners by exact arithmetic on the decimals as they are written."""
    points = sorted({(Fraction(x), Fraction(y)) for x, y in points})

    def chain(ordered):
        out = []
        for p in ordered:
            while len(out) > 1:
                o, a = out[-2:]
                if (a[0] - o[0]) * (p[1] - o[1]) > (a[1] - o[1]) * (p[0] - o[0]):
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    return {(float(x), float(y)) for x, y in chain(points) + chain(points[::-1])}


def _texts(rng, n, decimals, spread):
    units = rng.integers(-spread, spread + 1, (n, 2)) + np.array([12448500, 41873950]) * 10 ** (decimals - 6)
    return [tuple(f"{v // 10**decimals}.{v % 10**decimals:0{decimals}d}" for v in map(int, p)) for p in units]


@pytest.mark.parametrize("decimals", [6, 9, 12, 13])
@pytest.mark.parametrize("spread", [3, 8, 40])
def test_lattices(decimals, spread):
    rng = np.random.default_rng(spread)
    for n in (4, 10, 60, 300):
        texts = _texts(rng, n, decimals, spread)
        xy = np.array(texts, dtype=float)
        lon, lat = regions._hull(xy[:, 0], xy[:, 1])
        assert len(set(zip(lon, lat))) == len(lon)
        if len(lon) > 2:
            assert set(zip(lon.tolist(), lat.tolist())) == _corners(texts)


def test_places_on_a_slanted_side_are_no_corners():
    side = [(f"12.{448500 + 30 * k:06d}", f"41.{873950 + 70 * k:06d}") for k in range(40)]
    texts = [*side, ("12.5", "41.8"), ("12.6", "41.9")]
    xy = np.array(texts, dtype=float)
    lon, lat = regions._hull(xy[:, 0], xy[:, 1])
    assert len(lon) == 4 and set(zip(lon.tolist(), lat.tolist())) == _corners(texts)
    beside = np.vstack([xy, [xy[20, 0] - 1e-9, xy[20, 1]]])  # one place that does stick out
    assert len(regions._hull(beside[:, 0], beside[:, 1])[0]) == 5


def test_lines_have_no_hull(spark):
    rows = [("line", round(12.1 + 0.1 * k, 1), round(41.1 + 0.1 * k, 1)) for k in range(9)] + [("box", float(k % 3), float(k // 3)) for k in range(9)]
    rings = regions.convex_hull(spark.createDataFrame(rows, "term string, lon double, lat double")).collect()
    assert [r.term for r in rings] == ["box"] and len(rings[0].ring) == 5

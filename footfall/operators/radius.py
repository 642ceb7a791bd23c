"""Choice of the clustering radius from the k-th neighbour distances of a keyword.

All rules read the descending curve of distances as the histogram ``term, dist,
n`` and return ``term, eps`` in metres.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.operators.curves import elbow, histogram, with_positions
from footfall.operators.joins import HOT_ROWS, counted, lookup_join
from footfall.session import stage

THRESHOLD = 0.27
# Buckets that the positions of a curve are cut into for sampling.
POSITION_BUCKETS = 4096
COARSE_STEPS = 100


def eps_elbow(curve: DataFrame) -> DataFrame:
    """Radius at the elbow of the curve, which must have three points or more."""
    return elbow(curve, ["term"], "dist", short="error").select("term", F.col("y").alias("eps"))


def elbow_min_gap(curve: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Elbow among the points more than ``threshold`` below the chord."""
    return elbow(curve, ["term"], "dist", gap=threshold, short="error").select("term", "i", "d", F.col("y").alias("eps"))


def eps_percentile(curve: DataFrame, share: float) -> DataFrame:
    """Distance at position floor(n * share); the whole share gives the last one."""
    if not 0 <= share <= 1:
        raise ValueError("share must lie between 0 and 1")
    points = with_positions(curve, ["term"], "dist")
    position = F.least(F.floor(F.col("total") * share), F.col("total") - 1)
    here = (F.col("start") <= position) & (position < F.col("start") + F.col("n"))
    return points.filter(here).select("term", F.col("dist").alias("eps"))


def _first_true(low: np.ndarray, high: np.ndarray, test) -> np.ndarray:
    """First position of each range ``low .. high - 1`` where ``test(rows, positions)``
    holds, else ``high``; along a range the test may only turn from false to true."""
    low, high = low.copy(), high.copy()
    rows = np.flatnonzero(low < high)
    while len(rows):
        middle = (low[rows] + high[rows]) // 2
        holds = test(rows, middle)
        high[rows[holds]] = middle[holds]
        low[rows[~holds]] = middle[~holds] + 1
        rows = rows[low[rows] < high[rows]]
    return low


class _HullLevels:
    """Lower hulls of neighbouring groups of points with ascending x, doubled from level to level.

    ``vertex`` lists the hull vertices of all groups in order, ``first`` where each group
    begins. A level of groups of ``size`` points lets every point of an even group ask the
    hull of the group after it; over all levels each pair of points meets exactly once.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y, self.size = x, y, 1
        self.vertex, self.first = np.arange(len(x)), np.arange(len(x) + 1)

    def _slope(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.y[b] - self.y[a]) / (self.x[b] - self.x[a])

    def deepest(self, group: np.ndarray, slope: np.ndarray) -> np.ndarray:
        """Position in ``vertex`` of the vertex of each group that lies deepest below a line of that slope."""
        steep = lambda rows, at: self._slope(self.vertex[at], self.vertex[at + 1]) >= slope[rows]
        return _first_true(self.first[group], self.first[group + 1] - 1, steep)

    def double(self) -> None:
        """Join the hulls of each even group and its successor by their common tangent."""
        groups = len(self.first) - 1
        pairs = np.arange(0, groups - 1, 2)
        low, high = self.first[pairs + 1], self.first[pairs + 2] - 1

        def touch(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Where the tangent from a vertex on the left touches the right hull: its edges get steeper there."""
            start = self.vertex[at]
            steeper = lambda r, b: self._slope(self.vertex[b], self.vertex[b + 1]) >= self._slope(start[r], self.vertex[b])
            return _first_true(low[rows], high[rows], steeper)

        def below(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            tangent = self._slope(self.vertex[at], self.vertex[touch(rows, at)])
            return tangent <= self._slope(self.vertex[at], self.vertex[at + 1])

        ends = _first_true(self.first[pairs], self.first[pairs + 1] - 1, below)
        keep_to, keep_from = self.first[1:].copy(), self.first[:-1].copy()
        keep_to[pairs], keep_from[pairs + 1] = ends + 1, touch(np.arange(len(pairs)), ends)
        of = np.repeat(np.arange(groups), np.diff(self.first))
        place = np.arange(len(self.vertex))
        kept = (place < keep_to[of]) & (place >= keep_from[of])
        self.vertex = self.vertex[kept]
        sizes = np.bincount(of[kept] // 2, minlength=(groups + 1) // 2)
        self.first, self.size = np.append(0, np.cumsum(sizes)), 2 * self.size


def _lower_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the lower convex hull of points with ascending x."""
    levels = _HullLevels(x, y)
    while levels.size < len(x):
        levels.double()
    return levels.vertex


def _block_hull(rows: pd.DataFrame) -> pd.DataFrame:
    """Lower hull of one block, each vertex with the slopes of its two edges."""
    rows = rows[rows["start"] < rows["total"] - 1].sort_values("start")
    hull = rows.iloc[_lower_hull(rows["start"].to_numpy(float), rows["dist"].to_numpy())][["term", "block", "start", "dist"]]
    slopes = np.diff(hull["dist"].to_numpy()) / np.diff(hull["start"].to_numpy(float)) if len(hull) > 1 else np.empty(0)
    return hull.assign(slope_lo=np.append(-np.inf, slopes)[: len(hull)], slope_hi=np.append(slopes, np.inf)[: len(hull)])


def _later_vertices(points: DataFrame, hulls: DataFrame) -> DataFrame:
    """For each block, the hull vertices of later blocks that can matter to it.

    Below a chord of slope s the deepest point of a hull is the vertex whose edges
    have slopes on either side of s, so a block needs only the vertices that fit the
    slopes of its own chords. Only keywords with several blocks take part.
    """
    last = F.col("total") - 1
    end = F.least(F.col("start") + F.col("n") - 1, last - 2)
    height = F.col("y_last") - F.col("dist")
    ranges = points.filter(F.col("start") <= last - 2).groupBy("term", F.col("block").alias("for_block")).agg(
        (F.min(height / (last - end)) * (1 + 1e-9)).alias("chord_lo"),
        (F.max(height / (last - F.col("start"))) * (1 - 1e-9)).alias("chord_hi"),
    )
    fits = (F.col("slope_lo") <= F.col("chord_hi")) & (F.col("slope_hi") >= F.col("chord_lo"))
    several = stage(points.filter(F.col("block") > 0).select("term").distinct(), "several")
    ranges = ranges.join(counted(several), "term", "left_semi")
    pairs = hulls.join(counted(stage(ranges, "ranges")), "term").filter((F.col("block") > F.col("for_block")) & fits)
    return pairs.select("term", F.col("for_block").alias("block"), "start", "dist")


def _dips(x: np.ndarray, y: np.ndarray, last: int, y_last: float, run: np.ndarray, at: np.ndarray, threshold: float) -> np.ndarray:
    """Whether some point after point ``run`` lies more than ``threshold`` below the chord
    from position ``at``, at the height of point ``run``, to the end of the curve."""
    height = y[run] - y_last
    found = np.zeros(len(run), bool)
    levels = _HullLevels(x, y)
    while levels.size < len(x):
        group = run // levels.size
        rows = np.flatnonzero((group % 2 == 0) & (group + 1 < len(levels.first) - 1) & (height > 0) & ~found)
        group = group[rows] + 1
        deepest = levels.deepest(group, -height[rows] / (last - at[rows]))
        for near in (-1, 0, 1):  # the neighbours too, as slopes are rounded
            j = levels.vertex[np.clip(deepest + near, levels.first[group], levels.first[group + 1] - 1)]
            found[rows] |= (y[j] - y_last) / height[rows] < 1 - threshold - (x[j] - at[rows]) / (last - at[rows])
        levels.double()
    return found


def _far_flags(rows: pd.DataFrame, later: pd.DataFrame | None, threshold: float) -> pd.DataFrame:
    """Whether some later point of the curve lies more than ``threshold`` below the
    chord from point i to the end, for the first point of each run of equal values
    and for the coarse positions.

    With the chord from i fixed, the deepest of some later points is a vertex of their
    lower hull; all rows ask the hulls of each level at once.
    """
    rows = rows.sort_values("start")
    last = int(rows["total"].iloc[0]) - 1
    y_last = float(rows["y_last"].iloc[0])
    step = max(1, (last - 1) // min(COARSE_STEPS, last + 1))
    start, n, dist = (rows[c].to_numpy() for c in ("start", "n", "dist"))
    asked = np.flatnonzero(start <= last - 2)
    coarse = np.arange(-(-start[0] // step) * step, min(start[-1] + n[-1] - 1, last - 2) + 1, step)
    if start[0] <= last - 2 <= start[-1] + n[-1] - 1:
        coarse = np.union1d(coarse, [last - 2])
    run = np.append(asked, np.searchsorted(start, coarse, "right") - 1)
    at = np.append(start[asked], coarse)
    inside = start < last
    x, y = start[inside].astype(float), dist[inside].astype(float)
    if later is not None and len(later):
        later = later.sort_values("start")
        x, y = np.append(x, later["start"].to_numpy(float)), np.append(y, later["dist"].to_numpy(float))
    far = _dips(x, y, last, y_last, run, at, threshold)
    flags = pd.DataFrame({"i": at, "dist": dist[run], "far": far, "coarse": np.arange(len(run)) >= len(asked)})
    flags.insert(0, "term", rows["term"].iloc[0])
    return flags


def far_flags(curve: DataFrame, threshold: float = THRESHOLD, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Flags of :func:`_far_flags` for every keyword: ``term, i, dist, far, coarse``.

    The curve is processed in blocks of bounded size; a block sees the later ones
    only through vertices of their lower hulls.
    """
    points = with_positions(stage(curve, "curve"), ["term"], "dist", hot_rows=hot_rows, keep_block=True)
    points = stage(points, "positions")
    schema = "term string, i long, dist double, far boolean, coarse boolean"
    blocks = points.groupBy("term", "block")
    if points.filter(F.col("block") > 0).isEmpty():
        return blocks.applyInPandas(lambda rows: _far_flags(rows, None, threshold), schema)
    vertex = "term string, block int, start long, dist double, slope_lo double, slope_hi double"
    later = _later_vertices(points, stage(blocks.applyInPandas(_block_hull, vertex), "hulls"))
    pairs = blocks.cogroup(later.groupBy("term", "block"))
    return pairs.applyInPandas(
        lambda rows, later: _far_flags(rows, later, threshold) if len(rows) else pd.DataFrame(columns=["term", "i", "dist", "far", "coarse"]),
        schema,
    )


def eps_threshold(curve: DataFrame, threshold: float = THRESHOLD, hot_rows: int = HOT_ROWS) -> DataFrame:
    """First distance after which the curve never dips more than ``threshold`` below
    the chord to its end; the largest distance when there is none."""
    flags = far_flags(curve, threshold, hot_rows)
    stop = F.when(~F.col("far"), F.struct("i", "dist"))
    best = flags.groupBy("term").agg(F.min(stop).alias("stop"), F.max("dist").alias("top"))
    return best.select("term", F.coalesce("stop.dist", "top").alias("eps"))


def eps_threshold_coarse(curve: DataFrame, threshold: float = THRESHOLD, hot_rows: int = HOT_ROWS) -> DataFrame:
    """As :func:`eps_threshold`, but jumping ahead in about a hundred equal steps while
    they lie in the bent part, and searching one by one only after that."""
    flags = stage(far_flags(curve, threshold, hot_rows), "flags")
    coarse = flags.filter("coarse")
    miss = coarse.filter(~F.col("far")).groupBy("term").agg(F.min("i").alias("miss"))
    jump = coarse.join(miss, "term", "left").filter(F.col("miss").isNull() | (F.col("i") < F.col("miss")))
    reached = jump.groupBy("term").agg(F.max("i").alias("reached"))
    scan = flags.join(reached, "term", "left").filter(F.col("i") >= F.coalesce("reached", F.lit(0)))
    stops = scan.groupBy("term").agg(F.min(F.when(~F.col("far"), F.struct("i", "dist"))).alias("stop"))
    tops = flags.groupBy("term").agg(F.max("dist").alias("top"))
    return tops.join(stops, "term", "left").select("term", F.coalesce("stop.dist", "top").alias("eps"))


def eps_bootstrap(curve: DataFrame, repetitions: int, samples: int, seed: int = 0) -> DataFrame:
    """Median of the elbows of ``repetitions`` samples drawn with replacement.

    Draw numbers are hashed to positions of the curve by a linear congruence, so a
    run repeats.
    """
    points = stage(with_positions(stage(curve, "curve"), ["term"], "dist"), "positions")
    sizes = points.groupBy("term").agg(F.first("total").alias("total"))
    draws = sizes.select("term", "total", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("rep"))
    draws = draws.select("*", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("draw"))
    number = F.col("rep").cast("bigint") * 1000003 + F.col("draw") + seed
    mixed = (F.pmod(number, F.lit(2**31)) * 1103515245 + 12345) % 2**31
    drawn = F.floor(mixed / F.lit(2.0**31) * F.col("total"))
    draws = draws.select("term", "rep", drawn.alias("i")).groupBy("term", "rep", "i").agg(F.count(F.lit(1)).alias("times"))
    # Runs of equal values and draws meet in buckets of positions: a run takes one row
    # for each bucket that it reaches into, however many positions it holds.
    bucket = lambda i: F.floor(i / F.col("total") * POSITION_BUCKETS)
    first, last = bucket(F.col("start")), bucket(F.col("start") + F.col("n") - 1)
    runs = points.select("term", "dist", "start", "n", F.explode(F.sequence(first, last)).alias("bucket"))
    draws = draws.join(sizes, "term").withColumn("bucket", bucket(F.col("i"))).drop("total")
    met = lookup_join(runs, stage(draws, "draws"), ["term", "bucket"], ["start"])
    inside = (F.col("start") <= F.col("i")) & (F.col("i") < F.col("start") + F.col("n"))
    sampled = stage(met.filter(inside).select("term", "rep", "dist", "times"), "sampled")
    keys = ["term", "rep"]
    knees = elbow(histogram(sampled, keys, "dist", F.col("times")), keys, "dist", short="error", rows=sampled.count())
    return knees.groupBy("term").agg(F.median("y").alias("eps"))

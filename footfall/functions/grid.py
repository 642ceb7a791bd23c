"""Two grids: the metric post grid, and a grid on the sphere for radius joins; and a space-filling curve."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Degrees per metre along a meridian, and along the parallel of Rome.
DEGREE_PER_M_LAT = 8.992909382672273e-06
DEGREE_PER_M_LON = 1.2080663828690774e-05
# Bits of each axis in the position along the space-filling curve; a step is 19 mm.
AXIS_BITS = 31
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def grid_steps(size_m: float = 200, ref_lat: float | None = None) -> tuple[float, float]:
    """Cell height and width in degrees.

    The default width holds at 41.892 degrees north; ``ref_lat`` fits another region.
    """
    if ref_lat is None:
        return size_m * DEGREE_PER_M_LAT, size_m * DEGREE_PER_M_LON
    return size_m * DEGREE_PER_M_LAT, size_m * DEGREE_PER_M_LAT / math.cos(math.radians(ref_lat))


def with_cell(posts: DataFrame, size_m: float = 200, ref_lat: float | None = None) -> DataFrame:
    """Add the integer cell key ``cell_y, cell_x`` of each post."""
    step_y, step_x = grid_steps(size_m, ref_lat)
    return posts.withColumn(
        "cell_y", (F.col("latitude") / step_y).cast("bigint")
    ).withColumn("cell_x", (F.col("longitude") / step_x).cast("bigint"))


def cell_centre(size_m: float = 200, ref_lat: float | None = None) -> tuple[Column, Column]:
    """Centre latitude and longitude of ``cell_y, cell_x``."""
    step_y, step_x = grid_steps(size_m, ref_lat)
    return (
        (F.col("cell_y") + 1) * step_y - 0.5 * step_y,
        (F.col("cell_x") + 1) * step_x - 0.5 * step_x,
    )


# The sphere grid: rows of equal height; each row is cut into whole columns that
# are no wider than they are high, so a cell fits into a square of its side
# wherever it lies, and the columns of a row close up across the 180th meridian.


def sphere_row(lat: Column, side: Column) -> Column:
    """Row of a latitude for cells of ``side`` degrees."""
    return F.floor((lat + 90.0) / side)


def sphere_columns(row: Column, side: Column) -> Column:
    """Number of columns in a row."""
    low = row * side - 90.0
    high = low + side
    nearest_equator = F.when(low >= 0, low).when(high <= 0, high).otherwise(F.lit(0.0))
    return F.greatest(F.lit(1), F.ceil(F.cos(F.radians(nearest_equator)) * 360.0 / side))


def sphere_col(lon: Column, columns: Column) -> Column:
    """Column of a longitude in a row of ``columns`` columns."""
    return F.least(columns - 1, F.floor((lon + 180.0) / 360.0 * columns))


def with_sphere_cell(df: DataFrame, side: Column, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add the cell ``row, col`` of a point."""
    with_row = df.withColumn("row", sphere_row(F.col(lat), side))
    return with_row.withColumn("col", sphere_col(F.col(lon), sphere_columns(F.col("row"), side)))


def explode_sphere_cover(
    df: DataFrame,
    side: Column,
    radius: Column,
    lat_lo: str = "lat",
    lat_hi: str = "lat",
    lon_lo: str = "lon",
    lon_hi: str = "lon",
) -> DataFrame:
    """One row per cell that can hold a point within ``radius`` degrees of the point or box.

    The widest longitude difference on a circle of radius r about latitude p is
    asin(sin r / cos p); a circle that reaches a pole covers every column.
    """
    reach = radius * 1.000001 + 1e-9
    far = F.greatest(F.abs(F.col(lat_lo)), F.abs(F.col(lat_hi)))
    ratio = F.sin(F.radians(F.least(reach, F.lit(90.0)))) / F.cos(F.radians(far))
    wide = F.when(far + reach >= 90.0, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), ratio))) + 1e-9
    )
    first_row = F.greatest(F.lit(0), sphere_row(F.col(lat_lo) - reach, side))
    last_row = F.least(sphere_row(F.lit(90.0), side), sphere_row(F.col(lat_hi) + reach, side))
    rows = df.select("*", wide.alias("_wide"), F.explode(F.sequence(first_row, last_row)).alias("row"))
    rows = rows.withColumn("_n", sphere_columns(F.col("row"), side))
    first = F.floor((F.col(lon_lo) - F.col("_wide") + 180.0) / 360.0 * F.col("_n"))
    last = F.floor((F.col(lon_hi) + F.col("_wide") + 180.0) / 360.0 * F.col("_n"))
    cells = rows.withColumn("_first", first).withColumn("_last", last)
    cells = cells.withColumn(
        "_c", F.explode(F.sequence(F.col("_first"), F.least(F.col("_last"), F.col("_first") + F.col("_n") - 1)))
    )
    return cells.withColumn("col", F.pmod(F.col("_c"), F.col("_n"))).drop(
        "_wide", "_n", "_first", "_last", "_c"
    )


def _bits_apart(value: Column) -> Column:
    for shift, mask in _SPREAD:
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def curve_position(lon: Column, lat: Column) -> Column:
    """Place on a Z-order curve: the leading bits of two positions tell the quadtree cells they share."""
    step = 2.0**AXIS_BITS / 360.0
    axis = lambda degrees: F.least(F.floor(degrees * step), F.lit(2**AXIS_BITS - 1)).cast("bigint")
    return F.shiftleft(_bits_apart(axis(lat + 90.0)), 1).bitwiseOR(_bits_apart(axis(lon + 180.0)))

"""Local east-north-up frames on the WGS84 ellipsoid, and tile indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-axes of the ellipsoid in metres (fixed values).
A, B = 6378137.0, 6356752.314245179


def enu_to_ecef(lon: Column, lat: Column, height: Column) -> Column:
    """Column-major 4 x 4 matrix from local ENU metres at a place to earth-centred ones; null out of range."""
    lo, la = F.radians(lon), F.radians(lat)
    sl, cl, sp, cp = F.sin(lo), F.cos(lo), F.sin(la), F.cos(la)
    e2 = 1 - (B * B) / (A * A)
    n = A / F.sqrt(1 - e2 * sp * sp)
    zero, one = F.lit(0.0), F.lit(1.0)
    matrix = F.array(-sl, cl, zero, zero, -sp * cl, -sp * sl, cp, zero, cp * cl, cp * sl, sp, zero, (n + height) * cp * cl, (n + height) * cp * sl, (n * (1 - e2) + height) * sp, one)
    finite = ~F.isnan(height) & (F.abs(height) < float("inf"))
    return F.when(lon.between(-180, 180) & lat.between(-90, 90) & finite, matrix)


def tile_x(lon: Column, level: Column) -> Column:
    """Column of the geographic tile grid, two columns and one row at level 0."""
    width = F.call_function("shiftleft", F.lit(2), level)
    return F.greatest(F.lit(0), F.least(width - 1, F.floor((lon + 180) / 360 * width).cast("int")))


def tile_y(lat: Column, level: Column) -> Column:
    """Row of the grid, from the south."""
    height = F.call_function("shiftleft", F.lit(1), level)
    return F.greatest(F.lit(0), F.least(height - 1, F.floor((lat + 90) / 180 * height).cast("int")))


def tile_cover(west: Column, south: Column, east: Column, north: Column, level: Column) -> Column:
    """Array of struct(x, y): the tiles of a level that a box touches."""
    xs, ys = F.sequence(tile_x(west, level), tile_x(east, level)), F.sequence(tile_y(south, level), tile_y(north, level))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def zigzag(x: Column) -> Column:
    """Signed integers to unsigned, small ones first."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 31))


def quantised(x: Column, low: Column, high: Column) -> Column:
    """0 to 32767 along low .. high, rounded half to even."""
    return F.bround((x - low) / (high - low) * 32767).cast("int")

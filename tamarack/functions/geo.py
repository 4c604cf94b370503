"""Geohash cells and distances, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamarack.functions.binding import once

EARTH_M, PRECISION, NEAR_M, FAR_M = 6371008.8, 7, 50.0, 500.0
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "0123456789bcdefghjkmnpqrstuvwxyz"


def valid_point(lat: Column, lng: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))


def geohash(lat: Column, lng: Column, precision: int = PRECISION) -> Column:
    """The cell of a point, null for an unknown or impossible one.

    Halving an interval n times is the binary expansion of the point's place in it, so each axis is one
    integer and a character is five of the interleaved bits. A point on a midpoint counts as below it.
    """
    return F.when(valid_point(lat, lng), _cell(_column(lng, precision), _row(lat, precision), precision))


def _spread(x: Column, low: float, high: float, n: int) -> Column:
    """The place of ``x`` among 2 ** n equal parts, with a gap after each bit for those of the other axis."""
    place = F.greatest(F.lit(0), F.ceil((x - low) / F.lit((high - low) / (1 << n))) - 1).cast("long")
    return F.conv(F.bin(place), 4, 10).cast("long")


def _column(lng: Column, precision: int) -> Column:
    return _spread(lng, -180.0, 180.0, (5 * precision + 1) // 2)


def _row(lat: Column, precision: int) -> Column:
    return _spread(lat, -90.0, 90.0, 5 * precision // 2)


def _cell(x: Column, y: Column, precision: int) -> Column:
    code = x + 2 * y if precision % 2 else 2 * x + y
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 32), precision, "0"), _DIGITS, _BASE32)


def cell_size(precision: int = PRECISION) -> tuple[float, float]:
    """Degrees of latitude and longitude of a cell."""
    bits = 5 * precision
    return 180.0 / (1 << bits // 2), 360.0 / (1 << (bits + 1) // 2)


def neighbours(lat: Column, lng: Column, precision: int = PRECISION) -> Column:
    """The point's cell and those around it, each once, latitude clamped and longitude wrapped."""
    high, wide = cell_size(precision)

    def around(point: Column) -> Column:
        lat, lng = point["lat"], point["lng"]
        wrapped = lambda x: F.when(x > 180, x - 360).when(x < -180, x + 360).otherwise(x)
        rows = F.transform(F.array(*[lat + F.lit(d * high) for d in (0, -1, 1)]), lambda y: _row(F.least(F.greatest(y, F.lit(-90.0)), F.lit(90.0)), precision))
        columns = F.transform(F.array(*[lng + F.lit(d * wide) for d in (0, -1, 1)]), lambda x: _column(wrapped(x), precision))
        cells = once(columns, lambda xs: F.transform(rows, lambda y: F.transform(xs, lambda x: _cell(x, y, precision))))
        return F.when(valid_point(lat, lng), F.array_distinct(F.flatten(cells)))

    return once(F.struct(lat.cast("double").alias("lat"), lng.cast("double").alias("lng")), around)


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres; null if a coordinate is."""
    dy, dx = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    h = F.pow(F.sin(dy / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dx / 2), F.lit(2))
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def proximity(metres: Column) -> Column:
    """1 up to 50 m, falling to 0 at 500 m; unknown is 0."""
    return F.coalesce(F.when(metres <= NEAR_M, 1.0).when(metres >= FAR_M, 0.0).otherwise(F.round((FAR_M - metres) / (FAR_M - NEAR_M), 4)), F.lit(0.0))

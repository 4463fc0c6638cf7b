"""A grid of cells that are about square everywhere: bands of latitude, each with as many cells as its length allows.

A cell is a number: level, band and column. Level n has 2 ** n bands; the cells around a circle are listed per band, so the
180th meridian is crossed by counting modulo the band's columns, and around a pole a band is taken whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions.geo import EARTH_M

#: Deepest level: bands of about 150 m.
DEEPEST = 17


def _columns(band: Column, level: Column | int) -> Column:
    """How many cells a band has: by its edge nearest to the equator, so that cells are never narrower than high."""
    height = F.lit(180.0) / F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
    south = band * height - 90.0
    edge = F.when((south < 0) & (south + height > 0), 0.0).otherwise(F.least(F.abs(south), F.abs(south + height)))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(edge)) / height)).cast("long")


def _number(level: Column | int, band: Column, column: Column) -> Column:
    level = F.lit(level) if isinstance(level, int) else level
    return level.cast("long") * F.lit(1 << 44) + band * F.lit(1 << 22) + column


def _band(lat: Column, level: Column | int) -> Column:
    n = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
    return F.greatest(F.lit(0.0), F.least(n - 1, F.floor((lat + 90.0) / 180.0 * n))).cast("long")


def _column(lon: Column, columns: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / 360.0 * columns), columns).cast("long")


def cell(lat: Column, lon: Column, level: Column | int) -> Column:
    band = _band(lat, level)
    return _number(level, band, _column(lon, _columns(band, level)))


def around(lat: Column, lon: Column, radius_m: Column | float, level: Column | int) -> Column:
    """All cells of a level that a circle may touch."""
    radius = F.lit(radius_m) if isinstance(radius_m, (int, float)) else radius_m
    dlat = F.degrees(radius / EARTH_M) * 1.000001 + 1e-9
    reach = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(F.least(F.lit(90.0), dlat))) / F.cos(F.radians(lat))))) * 1.000001 + 1e-9
    dlon = F.when(F.abs(lat) + dlat >= 90, F.lit(180.0)).otherwise(reach)

    def of_band(band: Column) -> Column:
        n = _columns(band, level)
        first, last = F.floor((lon - dlon + 180.0) / 360.0 * n), F.floor((lon + dlon + 180.0) / 360.0 * n)
        last = F.least(last, first + n - 1)
        return F.transform(F.sequence(first, last), lambda c: _number(level, band, F.pmod(c, n).cast("long")))

    bands = F.sequence(_band(lat - dlat, level), _band(lat + dlat, level))
    return F.array_distinct(F.flatten(F.transform(bands, of_band)))


def level_of(radius_m: float) -> int:
    """The deepest level whose cells are not smaller than a radius."""
    return max(0, min(DEEPEST, math.floor(math.log2(math.pi * EARTH_M / max(radius_m, 1.0)))))


def inner_level(diameter_m: float) -> int:
    """The coarsest level in which any two points of a cell are within a distance: cells are at most twice as wide as high."""
    return max(0, min(DEEPEST, math.ceil(math.log2(math.pi * EARTH_M * math.sqrt(5) / diameter_m))))

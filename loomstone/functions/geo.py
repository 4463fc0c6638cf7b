"""Distances, map tiles and joins by place."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_M) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * radius)


def tile_x(lon: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((lon + 180.0) / 360.0 * n))).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    n = 1 << zoom
    s = F.sin(F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat))))
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * n))).cast("long")


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    """Digit by digit from the top: one for the x bit, two for the y bit."""
    digits = [(F.shiftright(x, b).bitwiseAND(1) + F.shiftright(y, b).bitwiseAND(1) * 2).cast("string") for b in range(zoom - 1, -1, -1)]
    return F.concat(*digits)


def quadkey_xy(key: Column, bit: int) -> Column:
    """x (bit 1) or y (bit 2) of a quadkey."""
    return F.aggregate(F.split(key, ""), F.lit(0).cast("long"), lambda a, d: F.when(d == "", a).otherwise(a * 2 + F.floor(d.cast("int") / bit) % 2))


def inside(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def radius_join(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Pairs within radius_m of (l_lat, l_lon) and (r_lat, r_lon), with distance_m.

    Spots meet first, each once, however many rows are there: those of the left side go to every cell that their circle may touch, those
    of the right side to their own, so this is an equi-join. Cells are as large as the radius (functions.grid), so a circle touches a few
    of them and a cell holds few pairs that are too far. Rows then meet by the spots that are near, so no pair is made that is none.
    """
    from loomstone.functions import grid

    level = grid.level_of(radius_m)
    ours, theirs = left.select("l_lat", "l_lon").distinct(), right.select("r_lat", "r_lon").distinct()
    ours = ours.withColumn("_cell", F.explode(grid.around(F.col("l_lat"), F.col("l_lon"), radius_m, level)))
    theirs = theirs.withColumn("_cell", grid.cell(F.col("r_lat"), F.col("r_lon"), level))
    d = haversine(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))
    near = ours.join(theirs, "_cell").withColumn("distance_m", d).where(F.col("distance_m") <= radius_m).drop("_cell")
    return left.join(near.join(right, ["r_lat", "r_lon"]), ["l_lat", "l_lon"]).select(*left.columns, *right.columns, "distance_m")


def tile_lat(y: Column, zoom: int) -> Column:
    """Latitude of a tile's centre."""
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * (y + 0.5) / (1 << zoom)))))


def tile_lon(x: Column, zoom: int) -> Column:
    """Longitude of a tile's centre."""
    return (x + 0.5) / (1 << zoom) * 360.0 - 180.0


def neighbours(x: Column, y: Column, zoom: int) -> Column:
    """Structs (x, y) of the tile and the up to eight around it; none beyond the map's edge."""
    last = (1 << zoom) - 1
    span = lambda c: F.sequence(F.greatest(F.lit(0), c - 1), F.least(F.lit(last), c + 1))
    return F.flatten(F.transform(span(x), lambda i: F.transform(span(y), lambda j: F.struct(i.cast("long").alias("x"), j.cast("long").alias("y")))))


def in_ring(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point is inside a ring of (lat, lon), by the parity of crossings to the east."""
    odd = F.lit(0)
    for (la, lo), (lb, lob) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if la != lb:
            odd = odd + F.when(((F.lit(la) > lat) != (F.lit(lb) > lat)) & (lon < (lat - la) * ((lob - lo) / (lb - la)) + lo), 1).otherwise(0)
    return F.coalesce(odd % 2 == 1, F.lit(False))


def in_polygon(lat: Column, lon: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Whether a point is inside the first ring and in none of the others, which are its holes."""
    out = in_ring(lat, lon, rings[0])
    for hole in rings[1:]:
        out = out & ~in_ring(lat, lon, hole)
    return out


def tile_polygon(x: Column, y: Column, zoom: int) -> Column:
    """Closed ring of (lon, lat) around a tile: north-west, north-east, south-east, south-west, and the first again."""
    n = 1 << zoom
    lon = lambda c: c / n * 360.0 - 180.0
    lat = lambda c: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * c / n))))
    west, east, north, south = lon(x), lon(x + 1), lat(y), lat(y + 1)
    return F.array(F.array(west, north), F.array(east, north), F.array(east, south), F.array(west, south), F.array(west, north))


def radius_cover(lat: Column, lon: Column, radius_m: float, zoom: int) -> Column:
    """Structs (x, y) of all tiles whose centre is within radius_m; the window is as wide as the radius needs at this latitude."""
    last = (1 << zoom) - 1
    x, y = tile_x(lon, zoom), tile_y(lat, zoom)
    # the narrowest tile that the circle may meet is the one nearest to a pole
    edge = F.least(F.lit(85.0), F.abs(lat) + math.degrees(radius_m / EARTH_M))
    width = F.cos(F.radians(edge)) * (2 * math.pi * EARTH_M / (1 << zoom))
    reach = F.ceil(F.lit(radius_m) / width).cast("long") + 1
    span = lambda c: F.sequence(F.greatest(F.lit(0), c - reach), F.least(F.lit(last), c + reach))
    every = F.flatten(F.transform(span(x), lambda i: F.transform(span(y), lambda j: F.struct(i.cast("long").alias("x"), j.cast("long").alias("y")))))
    return F.filter(every, lambda t: haversine(lat, lon, tile_lat(t["y"], zoom), tile_lon(t["x"], zoom)) <= radius_m)


def circle(lat: Column, lon: Column, radius_m: float, steps: int = 24) -> Column:
    """Closed polygon of (lon, lat) around a point."""
    d = math.degrees(radius_m / EARTH_M)
    turn = lambda i: F.radians(i * (360.0 / steps))
    points = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.array(lon + F.sin(turn(i)) * d / F.cos(F.radians(lat)), lat + F.cos(turn(i)) * d))
    return F.concat(points, F.slice(points, 1, 1))

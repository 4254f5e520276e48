"""Web-mercator tiles: their bounds and children, and those that cover a viewport."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Cover:
    """Zooms at which tiles are asked for, how many at once, and the latitude at which the map ends."""

    least_zoom: int = 10
    most_zoom: int = 15
    budget: int = 16
    max_lat: float = 85.05112878


def x_of(lng: Column, n: int) -> Column:
    return (lng + 180.0) / 360.0 * n


def y_of(lat: Column, n: int, p: Cover = Cover()) -> Column:
    clamped = F.greatest(F.lit(-p.max_lat), F.least(F.lit(p.max_lat), lat))
    return (1.0 - F.asinh(F.tan(F.radians(clamped))) / math.pi) / 2.0 * n


def viewport_range(west: Column, south: Column, east: Column, north: Column, z: int, p: Cover = Cover()) -> Column:
    """The struct (z, x0, x1, y0, y1) of tiles that a viewport meets; x runs on beyond the antimeridian, and a turn or more is all of them."""
    n = 1 << z
    far = F.when(east < west, east + 360.0).otherwise(east)
    whole = far - west >= 360.0
    row = lambda y: F.greatest(F.lit(0), F.least(F.lit(n - 1), y)).cast("int")
    x0 = F.when(whole, 0).otherwise(F.floor(x_of(west, n))).cast("int")
    x1 = F.when(whole, n - 1).otherwise(F.least(F.ceil(x_of(far, n)) - 1, F.floor(x_of(west, n)) + n - 1)).cast("int")
    return F.struct(F.lit(z).alias("z"), x0.alias("x0"), x1.alias("x1"), row(F.floor(y_of(north, n, p))).alias("y0"), row(F.ceil(y_of(south, n, p)) - 1).alias("y1"))


def range_size(r: Column) -> Column:
    return F.greatest(F.lit(0), r.x1 - r.x0 + 1) * F.greatest(F.lit(0), r.y1 - r.y0 + 1)


def cover_range(west: Column, south: Column, east: Column, north: Column, zoom: Column, p: Cover = Cover()) -> Column:
    """The range (z, x0, x1, y0, y1) of the tiles for a viewport: at its zoom, or at the first one out from it that needs budget tiles at most.

    At the least zoom the budget doesn't hold. x1 lies less than a turn from
    x0, so no tile comes twice; where an end lies before its start there is none.
    """
    wanted = F.greatest(F.lit(p.least_zoom), F.least(F.lit(p.most_zoom), F.floor(zoom)))
    chosen = viewport_range(west, south, east, north, p.least_zoom, p)
    for z in range(p.least_zoom + 1, p.most_zoom + 1):
        r = viewport_range(west, south, east, north, z, p)
        chosen = F.when((F.lit(z) <= wanted) & (range_size(r) <= p.budget), r).otherwise(chosen)
    return chosen


def cover(west: Column, south: Column, east: Column, north: Column, zoom: Column, p: Cover = Cover()) -> Column:
    """The array of tiles (z, x, y) in a viewport's cover_range.

    An east before west means that the viewport lies across the antimeridian;
    tiles beyond it have their own numbers, and none comes twice.
    """

    def tiles_of(r: Column) -> Column:
        n = F.call_function("shiftleft", F.lit(1), r.z)
        tile = lambda x: F.transform(F.sequence(r.y0, r.y1), lambda y: F.struct(r.z.alias("z"), F.pmod(x, n).alias("x"), y.alias("y")))
        return F.when(range_size(r) > 0, F.flatten(F.transform(F.sequence(r.x0, r.x1), tile)))

    # as the argument of a lambda, the range is found once, not for each tile
    tiles = F.get(F.transform(F.array(cover_range(west, south, east, north, zoom, p)), tiles_of), F.lit(0))
    return F.coalesce(tiles, F.expr("CAST(array() AS array<struct<z:int,x:int,y:int>>)"))


def bounds(z: Column, x: Column, y: Column) -> Column:
    """The struct (west, south, east, north) of a tile."""
    n = F.call_function("shiftleft", F.lit(1).cast("long"), z)
    lng = lambda v: v / n * 360.0 - 180.0
    lat = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * v / n))))
    return F.struct(lng(x).alias("west"), lat(y + 1).alias("south"), lng(x + 1).alias("east"), lat(y).alias("north"))


def children(z: Column, x: Column, y: Column) -> Column:
    """The four tiles of the next zoom in a tile: the upper two, then the lower two, each from the west."""
    return F.array(*[F.struct((z + 1).alias("z"), (2 * x + dx).alias("x"), (2 * y + dy).alias("y")) for dy in (0, 1) for dx in (0, 1)])


def in_viewport(lat: Column, lng: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether a point lies in a viewport, edges included, on either side of the antimeridian if that lies inside."""
    across = east < west
    return lat.between(south, north) & F.when(across, (lng >= west) | (lng <= east)).otherwise(lng.between(west, east))

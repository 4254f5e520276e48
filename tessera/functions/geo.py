"""Distances, bearings, tiles and cells as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.params import EARTH_M

M_PER_DEGREE = 111_320.0


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in metres; the inner term is clamped, as rounding can take it past 1."""
    dlat, dlng = F.radians(lat2 - lat1) / 2.0, F.radians(lng2 - lng1) / 2.0
    inner = F.pow(F.sin(dlat), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), 2.0)
    return 2.0 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), inner))))


def bearing_parts(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> tuple[Column, Column]:
    """East and north parts of the unit vector along the initial bearing; null where there is none."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    east = F.sin(d) * F.cos(b)
    north = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    size = F.hypot(east, north)
    some = size > 32 * 2.0**-52
    return F.when(some, east / size), F.when(some, north / size)


def degrees_of(east: Column, north: Column) -> Column:
    """Compass bearing from 0 to 360."""
    turn = F.degrees(F.atan2(east, north))
    return F.when(turn < 0, turn + 360.0).otherwise(turn)


def tile_x(lng: Column, zoom: int) -> Column:
    n = 1 << zoom
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((lng + 180.0) / 360.0 * n))).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    n = 1 << zoom
    y = (1.0 - F.ln(F.tan(F.radians(lat)) + 1.0 / F.cos(F.radians(lat))) / math.pi) / 2.0 * n
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(y))).cast("int")


def shoelace_m2(lats: Column, lngs: Column, lat0: Column) -> Column:
    """Area of a ring of vertices (arrays, first vertex not repeated), by local scaling at lat0."""
    n = F.size(lats)
    ring = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((F.get(lngs, i) * M_PER_DEGREE * F.cos(F.radians(lat0))).alias("x"), (F.get(lats, i) * M_PER_DEGREE).alias("y")))
    cross = F.aggregate(
        F.sequence(F.lit(0), n - 1),
        F.lit(0.0),
        lambda s, i: s + F.get(ring, i).x * F.get(ring, (i + 1) % n).y - F.get(ring, (i + 1) % n).x * F.get(ring, i).y,
    )
    return F.abs(cross) / 2.0


def edges_of(lats: Column, lngs: Column) -> Column:
    """The edges of a ring of vertices, the last back to the first."""
    n = F.size(lats)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(lngs, i).alias("x1"), F.get(lats, i).alias("y1"), F.get(lngs, (i + 1) % n).alias("x2"), F.get(lats, (i + 1) % n).alias("y2")))


def on_edge(lat: Column, lng: Column, edges: Column) -> Column:
    side = lambda e: (e.x2 - e.x1) * (lat - e.y1) - (e.y2 - e.y1) * (lng - e.x1)
    return F.exists(edges, lambda e: (side(e) == 0) & lng.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2)) & lat.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2)))


def crossed(lat: Column, lng: Column, edges: Column) -> Column:
    """How many edges a ray to the east crosses."""
    return F.size(F.filter(edges, lambda e: ((e.y1 > lat) != (e.y2 > lat)) & (lng < e.x1 + (lat - e.y1) * (e.x2 - e.x1) / F.nullif(e.y2 - e.y1, F.lit(0.0)))))


def inside(lat: Column, lng: Column, lats: Column, lngs: Column) -> Column:
    """Whether a ring covers a point, its edges and corners included."""
    edges = edges_of(lats, lngs)
    return on_edge(lat, lng, edges) | (crossed(lat, lng, edges) % 2 == 1)


def inside_rings(lat: Column, lng: Column, rings: Column) -> Column:
    """Whether an area of several parts and holes (hole, lngs, lats) covers a point, edges of holes included."""
    edges = F.flatten(F.transform(rings, lambda r: edges_of(r.lats, r.lngs)))
    return on_edge(lat, lng, edges) | (crossed(lat, lng, edges) % 2 == 1)

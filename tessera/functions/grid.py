"""National grid cells: ids to projected corners, and those to latitude and longitude."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of squares of 100 km from the origin, and the projection (transverse Mercator on GRS80).
EAST_LETTERS, NORTH_LETTERS = "가나다라마바사", "가나다라마바사아"
ORIGIN_E, ORIGIN_N, SQUARE, UNIT, CELL = 700_000.0, 1_300_000.0, 100_000.0, 10.0, 250.0
AXIS, FLATTENING = 6_378_137.0, 1 / 298.257222101
LAT0, LNG0, SCALE, FALSE_E, FALSE_N = 38.0, 127.5, 0.9996, 1_000_000.0, 2_000_000.0

E2 = FLATTENING * (2 - FLATTENING)
EP2 = E2 / (1 - E2)


def _arc(lat: float) -> float:
    """Length of the meridian from the equator."""
    e4, e6 = E2**2, E2**3
    return AXIS * (
        (1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * lat
        - (3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * math.sin(2 * lat)
        + (15 * e4 / 256 + 45 * e6 / 1024) * math.sin(4 * lat)
        - 35 * e6 / 3072 * math.sin(6 * lat)
    )


def corner(cell: Column) -> tuple[Column, Column]:
    """Easting and northing of a cell's south-west corner; null for ids that aren't on the lattice of CELL metres."""
    text = F.trim(cell)
    ok = text.rlike(f"^[{EAST_LETTERS}][{NORTH_LETTERS}][0-9]{{8}}$")
    letter = lambda i, letters: F.position(F.substring(text, i, 1), F.lit(letters)) - 1
    number = lambda i: F.substring(text, i, 4).try_cast("int") * UNIT
    e, n = number(3), number(7)
    ok = ok & (e % CELL == 0) & (n % CELL == 0)
    return F.when(ok, ORIGIN_E + letter(1, EAST_LETTERS) * SQUARE + e), F.when(ok, ORIGIN_N + letter(2, NORTH_LETTERS) * SQUARE + n)


def to_lat_lng(east: Column, north: Column) -> tuple[Column, Column]:
    """The inverse transverse Mercator projection by the series in J. P. Snyder, Map Projections: A Working Manual (1987)."""
    m = _arc(math.radians(LAT0)) + (north - FALSE_N) / SCALE
    mu = m / (AXIS * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    foot = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu) + 1097 * e1**4 / 512 * F.sin(8 * mu)
    c = EP2 * F.pow(F.cos(foot), 2.0)
    t = F.pow(F.tan(foot), 2.0)
    w = 1 - E2 * F.pow(F.sin(foot), 2.0)
    n1 = AXIS / F.sqrt(w)
    r1 = AXIS * (1 - E2) / F.pow(w, 1.5)
    d = (east - FALSE_E) / (n1 * SCALE)
    lat = foot - n1 * F.tan(foot) / r1 * (
        d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * EP2) * F.pow(d, 4.0) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * EP2 - 3 * c * c) * F.pow(d, 6.0) / 720
    )
    lng = (d - (1 + 2 * t + c) * F.pow(d, 3.0) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * EP2 + 24 * t * t) * F.pow(d, 5.0) / 120) / F.cos(foot)
    return F.degrees(lat), LNG0 + F.degrees(lng)


def ring(cell: Column) -> Column:
    """A cell's corners from the south-west counter-clockwise, as an array of (lat, lng)."""
    e, n = corner(cell)
    return F.array(*[F.struct(*(c.alias(k) for c, k in zip(to_lat_lng(e + dx * CELL, n + dy * CELL), ("lat", "lng")))) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))])

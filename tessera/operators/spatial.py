"""Joins by distance."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geo import M_PER_DEGREE, haversine_m
from tessera.params import EARTH_M


def with_cells(df: DataFrame, lat: str, lng: str, size_m: float, spread: bool, max_lat: float = 60.0) -> DataFrame:
    """Adds _cy and _cx, a cell of at least size_m each way; spread: one row for each of the 3 x 3 cells around."""
    if not 0 < max_lat < 89:
        raise ValueError("cells need latitudes away from the poles")
    dy = size_m / M_PER_DEGREE * 1.01
    dx = dy / math.cos(math.radians(max_lat))
    cy, cx = F.floor(F.col(lat) / dy).cast("long"), F.floor(F.col(lng) / dx).cast("long")
    if not spread:
        return df.withColumn("_cy", cy).withColumn("_cx", cx)
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return df.withColumn("_d", F.explode(around)).withColumn("_cy", cy + F.col("_d.a")).withColumn("_cx", cx + F.col("_d.b")).drop("_d")


def radius_pairs(points: DataFrame, places: DataFrame, radius_m: float, max_lat: float = 60.0) -> DataFrame:
    """All pairs of a point (lat, lng) and a place (p_lat, p_lng) within radius_m, with distance_m.

    Places are repeated in the cells around theirs, so pairs meet by equal
    cells and no nested loop is needed; a pair meets once. Latitudes beyond
    max_lat either way give cells that are too narrow and must not occur.
    """
    a = with_cells(points, "lat", "lng", radius_m, False, max_lat)
    b = with_cells(places, "p_lat", "p_lng", radius_m, True, max_lat)
    d = haversine_m(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))
    return a.join(b, ["_cy", "_cx"]).withColumn("distance_m", d).where(F.col("distance_m") <= radius_m).drop("_cy", "_cx")


def nearest_k(pairs: DataFrame, point: str | Sequence[str], place: str, k: int) -> DataFrame:
    """Adds rank from 1 and keeps the k nearest places of each point, named by one column or several; equal distances go by place."""
    order = Window.partitionBy(*([point] if isinstance(point, str) else point)).orderBy("distance_m", place)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_at(points: DataFrame, places: DataFrame, place: str, radius_m: float, k: int, max_lat: float = 60.0) -> DataFrame:
    """The k nearest places of each spot (lat, lng) of points within radius_m, with distance_m and rank.

    As nearest_k over radius_pairs, but all points at one spot have the same
    neighbours and are asked for once; and of the places at one spot only the
    first k can count, as equal distances go by place.
    """
    order = Window.partitionBy("p_lat", "p_lng").orderBy(place)
    first = places.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")
    return nearest_k(radius_pairs(points.select("lat", "lng").distinct(), first, radius_m, max_lat), ["lat", "lng"], place, k)


def cube_pairs(points: DataFrame, places: DataFrame, size_m: float) -> DataFrame:
    """Pairs of points (lat, lng) and places (p_lat, p_lng) whose cubes of size_m in the sphere's own space are equal or touch.

    Adds the coordinates _ax to _az and _bx to _bz. All pairs within size_m
    are among them, at any latitude.
    """

    def placed(df: DataFrame, lat: str, lng: str, p: str) -> DataFrame:
        a, b = F.radians(lat), F.radians(lng)
        return df.withColumns({f"{p}x": EARTH_M * F.cos(a) * F.cos(b), f"{p}y": EARTH_M * F.cos(a) * F.sin(b), f"{p}z": EARTH_M * F.sin(a)})

    cube = lambda c, d=0: F.floor(F.col(c) / size_m) + d
    a = placed(points, "lat", "lng", "_a").withColumns({"_i": cube("_ax"), "_j": cube("_ay"), "_k": cube("_az")})
    steps = [F.struct(*(cube(c, d).alias(n) for c, d, n in zip(("_bx", "_by", "_bz"), ds, ("i", "j", "k")))) for ds in ((x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1))]
    b = placed(places, "p_lat", "p_lng", "_b").withColumn("_c", F.explode(F.array(*steps))).select("*", F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j"), F.col("_c.k").alias("_k")).drop("_c")
    return a.join(b, ["_i", "_j", "_k"]).drop("_i", "_j", "_k")


def keyed_pairs(points: DataFrame, places: DataFrame, key: str, within_m: float, wide: int = 8) -> DataFrame:
    """Pairs of points (lat, lng) and places (p_lat, p_lng) with an equal key within within_m; a pair meets once.

    They meet by key in cubes wide times as large in the sphere's own space. A
    place is repeated in each that its surroundings touch: two on average and
    eight at most, where cubes as large as within_m would take 27.
    """
    size, reach = wide * within_m, within_m * 1.001  # a little more, against rounding

    def ends(lat: str, lng: str, by_m: float) -> dict[str, list]:
        a, b = F.radians(lat), F.radians(lng)
        at = {"_i": EARTH_M * F.cos(a) * F.cos(b), "_j": EARTH_M * F.cos(a) * F.sin(b), "_k": EARTH_M * F.sin(a)}
        return {n: [F.floor((x + d) / size) for d in (-by_m, by_m)] for n, x in at.items()}

    a = points.withColumns({n: low for n, (low, _) in ends("lat", "lng", 0.0).items()})
    touched = {n: F.array_distinct(F.array(*both)) for n, both in ends("p_lat", "p_lng", reach).items()}
    b = places
    for n, cubes in touched.items():
        b = b.withColumn(n, F.explode(cubes))
    d = haversine_m(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))
    # neither side is broadcast: what explode makes of a few rows isn't in the estimate of their size
    return a.hint("merge").join(b, [key, "_i", "_j", "_k"]).where(d <= within_m).drop("_i", "_j", "_k")


def ecef_pairs(points: DataFrame, places: DataFrame, within_m: float) -> DataFrame:
    """Pairs by straight-line distance within within_m, met in cubes of the sphere's own space; fit for any latitude."""
    gap = F.sqrt(F.pow(F.col("_ax") - F.col("_bx"), 2.0) + F.pow(F.col("_ay") - F.col("_by"), 2.0) + F.pow(F.col("_az") - F.col("_bz"), 2.0))
    return cube_pairs(points, places, within_m).withColumn("distance_m", gap).where(F.col("distance_m") <= within_m).drop("_ax", "_ay", "_az", "_bx", "_by", "_bz")

"""Stations out of stops: clusters by name and nearness, and exits that belong to them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.address import exit_number, station_name
from tessera.functions.geo import haversine_m
from tessera.operators.components import components
from tessera.operators.spatial import nearest_at, radius_pairs

# Fixed value: the radius that clusters are measured with
RADIUS_M = 6_371_000.0


def near_stops(stops: DataFrame, near_m: float, max_lat: float = 60.0) -> DataFrame:
    """Edges (u, v) between stops (stop_id, key, lat, lng) of one key that link all within near_m, if not each with each.

    Stops of a key stand in cells whose corners lie within near_m of each
    other, so all stops of a cell are linked to its first. Stops of different
    cells meet by the cells around; of those that are near, each pair of cells
    keeps one edge, and stops at one place meet once.
    """
    if not 0 < max_lat < 89:
        raise ValueError("cells need latitudes away from the poles")
    degree = RADIUS_M * math.pi / 180
    side = near_m / math.sqrt(2) / degree * 0.999
    up = math.ceil(near_m / degree / side)
    across = math.ceil(near_m / (degree * math.cos(math.radians(max_lat))) / side)
    cells = stops.where("lat IS NOT NULL AND lng IS NOT NULL").select("stop_id", "key", "lat", "lng", F.floor(F.col("lat") / side).alias("cy"), F.floor(F.col("lng") / side).alias("cx"))
    first = cells.groupBy("key", "cy", "cx").agg(F.min("stop_id").alias("first"))
    within = cells.join(first, ["key", "cy", "cx"]).select(F.col("first").alias("u"), F.col("stop_id").alias("v"))
    places = cells.groupBy("key", "cy", "cx", "lat", "lng").agg(F.lit(1).alias("_one")).drop("_one").join(first, ["key", "cy", "cx"])
    steps = [(y, x) for y in range(0, up + 1) for x in range(-across, across + 1) if (y, x) > (0, 0)]  # each pair of cells once
    around = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in steps]))
    spread = places.withColumn("_d", around).select("key", (F.col("cy") + F.col("_d.y")).alias("cy"), (F.col("cx") + F.col("_d.x")).alias("cx"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.col("first").alias("u"))
    met = places.withColumnRenamed("first", "v").join(spread, ["key", "cy", "cx"])
    near = met.where(haversine_m(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"), RADIUS_M) <= near_m)
    return within.union(near.select("u", "v").distinct())


def cluster_stops(stops: DataFrame, near_m: float = 350.0, name: Column | None = None) -> DataFrame:
    """Adds station_id to stops (stop_id, name, lat, lng): the least stop_id linked by steps up to near_m within a name.

    Names are compared as they are, or by the column name. A stop without a
    place is a station of its own.
    """
    keyed = stops.withColumn("key", F.coalesce(F.col("name") if name is None else name, F.lit("")))
    roots = components(near_stops(keyed.select("stop_id", "key", "lat", "lng"), near_m))
    out = stops.join(roots.select(F.col("node").alias("stop_id"), F.col("root").alias("station_id")), "stop_id", "left")
    return out.withColumn("station_id", F.coalesce("station_id", "stop_id"))


def build_stations(stops: DataFrame, near_m: float = 350.0, places: int = 6) -> DataFrame:
    """A row for each station out of stops (stop_id, name, line, lat, lng), where names agree without space and suffix.

    Columns: station_id, name (the most frequent, then the shortest, then the
    first), lines in order, stops, label_priority (10 less the lines, 1 at least), and
    lat and lng, the means of the stops' places, rounded.
    """
    clustered = cluster_stops(stops, near_m, station_name(F.col("name")))
    by_name = clustered.groupBy("station_id", "name").agg(F.count(F.lit(1)).alias("n"), F.sum("lat").alias("lat"), F.sum("lng").alias("lng"), F.count("lat").alias("placed"), F.collect_set("line").alias("lines"))
    rank = F.struct((-F.col("n")).alias("n"), F.length("name").alias("size"), "name")
    made = by_name.groupBy("station_id").agg(
        F.min(rank).alias("best"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"),
        F.sum("n").alias("stops"),
        F.round(F.try_divide(F.sum("lat"), F.sum("placed")), places).alias("lat"),
        F.round(F.try_divide(F.sum("lng"), F.sum("placed")), places).alias("lng"),
    )
    priority = 10 - F.least(F.lit(9), F.size("lines"))
    return made.select("station_id", F.col("best.name").alias("name"), "lines", "stops", priority.alias("label_priority"), "lat", "lng")


def link_exits(exits: DataFrame, stations: DataFrame, within_m: float = 700.0) -> DataFrame:
    """Each exit (exit_id, lat, lng) with the nearest station (station_id, p_lat, p_lng), or null beyond within_m."""
    best = nearest_at(exits, stations, "station_id", within_m, 1).select("lat", "lng", "station_id", "distance_m")
    return exits.select("exit_id", "lat", "lng").join(best, ["lat", "lng"], "left").select("exit_id", "station_id", "distance_m")


def named_exits(entrances: DataFrame, stations: DataFrame, within_m: float = 700.0, labels: Sequence[str] = ("label",), ref: str = "ref") -> DataFrame:
    """Numbered exits out of entrances (exit_id, lat, lng, ref and labels) with the nearest station that a label names.

    stations has station_id, name, lat and lng. Columns: station_id (null if
    no named station lies within within_m), station_name, exit_no, lat, lng,
    exit_id. Of entrances with one station (or none and no other id), number
    and place, the least exit_id stays; those without number or place go.
    Only stations within reach are compared, as a farther one links nothing.
    """
    number = exit_number(F.col(ref), *map(F.col, labels))
    numbered = entrances.where("lat IS NOT NULL AND lng IS NOT NULL").withColumn("exit_no", number).where("exit_no IS NOT NULL")
    text = station_name(F.concat_ws(" ", *labels))
    rows = numbered.select("exit_id", "exit_no", "lat", "lng", text.alias("_text"))
    places = stations.select("station_id", F.col("name").alias("station_name"), station_name(F.col("name")).alias("_name"), F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    far = within_m * 1.001  # cells are measured on another sphere
    d = haversine_m(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"), RADIUS_M)
    named = radius_pairs(rows, places, far).where(F.col("_text").contains(F.col("_name"))).withColumn("_d", d).where(F.col("_d") <= within_m)
    best = named.groupBy("exit_id").agg(F.min_by(F.struct("station_id", "station_name"), F.struct("_d", "station_id")).alias("s"))
    linked = rows.drop("_text").join(best, "exit_id", "left").select("exit_id", "exit_no", "lat", "lng", "s.*")
    owner = F.when(F.col("station_id").isNull(), F.col("exit_id"))
    return linked.groupBy("station_id", "station_name", "exit_no", "lat", "lng", owner.alias("_own")).agg(F.min("exit_id").alias("exit_id")).drop("_own")

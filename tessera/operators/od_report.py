"""The report on origin-destination flows of a day: movements by zone and hour, and how much of them has a place."""

from __future__ import annotations

from collections.abc import Collection
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import flows as od

ALL_DAY = tuple(range(24))


def selected(flows: DataFrame, day: date, hours: Collection[int] | None = None) -> DataFrame:
    """Flows of the day that leave or arrive in one of the hours (all by default); a row of another day is an error when it is read."""
    if hours is not None and (not hours or not all(isinstance(h, int) and 0 <= h <= 23 for h in hours)):
        raise ValueError("hours are whole numbers from 0 to 23")
    today = F.coalesce(F.col("observed_date") == F.lit(day), F.lit(False))
    checked = flows.where(F.when(today, F.lit(True)).otherwise(F.raise_error(F.lit("a row is of another day")).cast("boolean")))
    touched = F.col("departure_hour").isin(list(hours)) | F.col("arrival_hour").isin(list(hours)) if hours is not None else F.lit(True)
    return checked.where(touched)


def placed(flows: DataFrame, centroids: DataFrame) -> DataFrame:
    """flows with whether the places of both ends are known."""
    c = centroids.select("zone_id", F.lit(True).alias("_there")).distinct()
    o, d = (c.select(F.col("zone_id").alias(k), F.col("_there").alias(f"_{k}")) for k in ("origin_id", "destination_id"))
    both = flows.join(o, "origin_id", "left").join(d, "destination_id", "left")
    known = lambda k: F.coalesce(F.col(f"_{k}"), F.lit(False))
    return both.withColumns({"origin_known": known("origin_id"), "destination_known": known("destination_id")}).drop("_origin_id", "_destination_id")


def movements(flows: DataFrame, centroids: DataFrame, hours: Collection[int] | None = None) -> DataFrame:
    """A row for each zone and hour (of hours alone) of selected flows with distance_m and duration_min.

    Counts have six decimals, shares and vectors nine. purposes is an array of
    (purpose, count, ratio) of inbound flow in order; means of distance and
    duration are by inbound flow, null without. A heading points where flow
    comes to rest, the origin bearing back. Zones without a place have a
    null one.
    """
    hours = ALL_DAY if hours is None else sorted(set(hours))
    f = placed(flows, centroids)
    inside = F.col("origin_id") == F.col("destination_id")
    known = F.col("origin_known") & F.col("destination_known")
    arrived = f.groupBy(F.col("destination_id").alias("zone_id"), F.col("arrival_hour").alias("hour")).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(known).alias("placed_rows"),
        F.sum(F.when(known, F.col("flow")).otherwise(0.0)).alias("placed_flow"),
        F.sum(F.col("flow") * F.col("distance_m")).alias("_distance"),
        F.sum(F.col("flow") * F.col("duration_min")).alias("_duration"),
    )
    left = f.where(inside).groupBy(F.col("origin_id").alias("zone_id"), F.col("departure_hour").alias("hour")).agg(F.sum("flow").alias("intrazonal_outbound"))
    by_purpose = f.groupBy(F.col("destination_id").alias("zone_id"), F.col("arrival_hour").alias("hour"), "purpose").agg(F.sum("flow").alias("flow"))
    purposes = by_purpose.groupBy("zone_id", "hour").agg(F.sort_array(F.collect_list(F.struct("purpose", "flow"))).alias("_p"), F.sum("flow").alias("_all"))
    heading = od.direction(flows, centroids).drop("eligible")
    rows = od.net_flow(flows).where(F.col("hour").isin(hours))
    for more in (arrived, left, purposes, heading):
        rows = rows.join(more, ["zone_id", "hour"], "left")
    rows = rows.join(centroids.select("zone_id", "name", "lat", "lng"), "zone_id", "left")
    r = lambda c, n: F.round(c, n)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    item = lambda x: F.struct(x.purpose.alias("purpose"), r(x.flow, 6).alias("count"), r(F.try_divide(x.flow, F.col("_all")), 9).alias("ratio"))
    some = F.col("inbound") > 0
    turn = F.radians("bearing")
    return rows.select(
        "zone_id",
        "name",
        "hour",
        F.format_string("%02d:00", "hour").alias("local_time"),
        *[r(F.col(c), 6).alias(c) for c in ("inbound", "outbound", "net")],
        r(F.col("intrazonal"), 6).alias("intrazonal_inbound"),
        r(zero(F.col("intrazonal_outbound")), 6).alias("intrazonal_outbound"),
        F.coalesce(F.transform("_p", item), F.expr("CAST(array() AS array<struct<purpose:int,count:double,ratio:double>>)")).alias("purposes"),
        F.when(some, r(F.col("_distance") / F.col("inbound"), 6)).alias("mean_distance_m"),
        F.when(some, r(F.col("_duration") / F.col("inbound"), 6)).alias("mean_duration_min"),
        F.when(F.col("lat").isNotNull(), F.struct("lat", "lng")).alias("centroid"),
        F.coalesce("placed_rows", F.lit(0)).alias("placed_rows"),
        F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        F.when(some, r(zero(F.col("placed_flow")) / F.col("inbound"), 9)).alias("placed_ratio"),
        r(F.col("strength") * F.sin(turn), 9).alias("east"),
        r(F.col("strength") * F.cos(turn), 9).alias("north"),
        r(F.col("bearing"), 6).alias("heading_deg"),
        r((F.col("bearing") + 180.0) % 360.0, 6).alias("origin_bearing_deg"),
        r(F.col("strength"), 9).alias("strength"),
        r(zero(F.col("coverage")), 9).alias("direction_coverage"),
    )


def coverage(flows: DataFrame, scanned: Column, centroids: DataFrame) -> DataFrame:
    """One row about selected flows: rows, flow, zones, and how many of each have places; codes without one in order."""
    f = placed(flows, centroids)
    both, inside = F.col("origin_known") & F.col("destination_known"), F.col("origin_id") == F.col("destination_id")
    zones = f.select(F.explode(F.array(F.struct(F.col("origin_id").alias("z"), F.col("origin_known").alias("k")), F.struct(F.col("destination_id").alias("z"), F.col("destination_known").alias("k")))).alias("x")).select("x.*").distinct()
    seen = zones.agg(F.count(F.lit(1)).alias("zones"), F.count_if("k").alias("placed_zones"))
    missing = lambda c: F.sort_array(F.collect_set(F.when(~F.col(f"{c}_known"), F.col(f"{c}_id")))).alias(f"missing_{c}s")
    sums = f.agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.sum("flow"), 6).alias("flow"),
        F.count_if(both).alias("placed_rows"),
        F.round(F.sum(F.when(both, F.col("flow")).otherwise(0.0)), 6).alias("placed_flow"),
        F.round(F.try_divide(F.count_if(both), F.count(F.lit(1))), 9).alias("placed_row_ratio"),
        F.round(F.try_divide(F.sum(F.when(both, F.col("flow")).otherwise(0.0)), F.sum("flow")), 9).alias("placed_flow_ratio"),
        F.count_if(inside).alias("intrazonal_rows"),
        F.round(F.sum(F.when(inside, F.col("flow")).otherwise(0.0)), 6).alias("intrazonal_flow"),
        missing("origin"),
        missing("destination"),
    )
    return sums.crossJoin(seen).select(scanned.alias("rows_scanned"), "*", F.round(F.try_divide("placed_zones", "zones"), 9).alias("zone_ratio"))  # a row each

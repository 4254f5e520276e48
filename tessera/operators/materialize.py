"""Everything that reads are served from, built in one pass: point scores and the states of hotspots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.timing import minutes_between
from tessera.operators.scoring import latest_polled, score_points, weighted
from tessera.operators.spatial import nearest_at
from tessera.params import PointScore


def contributors(points: DataFrame, observations: DataFrame, p: PointScore = PointScore()) -> DataFrame:
    """For each cafe_id with neighbours, the array of (hotspot_id, distance_m, level, weight), nearest first; weights sum to one."""
    near = nearest_at(points, observations, "hotspot_id", p.radius_m, p.neighbours)
    return points.select("cafe_id", "lat", "lng").join(weighted(near, ["lat", "lng"], p, True), ["lat", "lng"]).select("cafe_id", "contributors")


def materialize_scores(cafes: DataFrame, hotspots: DataFrame, snapshots: DataFrame, now: Column, p: PointScore = PointScore()) -> DataFrame:
    """Scores of the active cafes with their contributors; both are null where nothing is near. One radius join makes both."""
    return score_points(cafes.where("active"), latest_polled(snapshots, hotspots), now, p, True).withColumn("computed_at", now)


def one_hour_on(forecast: Column, observed: Column) -> Column:
    """The entry of a forecast whose time, at, is nearest to an hour after the observation; the first of equally near ones."""
    off = lambda x: F.abs(F.unix_micros(x.at.cast("timestamp")) - F.unix_micros(observed.cast("timestamp")) - 3_600_000_000)
    timed = F.filter(F.transform(forecast, lambda x, i: F.struct(off(x).alias("off"), i.alias("i"), x.alias("of"))), lambda x: x.off.isNotNull())
    return F.array_min(F.transform(timed, lambda x: F.struct(x.off.alias("off"), x.i.alias("i"), x.of.alias("of")))).getField("of")


def serving_states(hotspots: DataFrame, snapshots: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    """A row for each polled hotspot observed in the last hours: trend, in the order of time, and the forecast for an hour on.

    snapshots has a column forecast, an array of structs with the time at.
    observed_at is the last of the trend; the forecast is the latest one's.
    """
    recent = snapshots.join(hotspots.where("is_polled").select("hotspot_id"), "hotspot_id").where(minutes_between(now, F.col("observed_at")) <= 60 * hours)
    last = F.max_by(F.struct("observed_at", "forecast"), F.struct("observed_at", "event_id"))
    rows = recent.groupBy("hotspot_id").agg(F.sort_array(F.collect_list(F.struct("observed_at", "event_id", "level"))).alias("t"), last.alias("last"))
    return rows.select(
        "hotspot_id",
        now.alias("computed_at"),
        F.col("last.observed_at").alias("observed_at"),
        F.transform("t", lambda x: F.struct(x.observed_at.alias("observed_at"), x.level.alias("level"))).alias("trend"),
        one_hour_on(F.col("last.forecast"), F.col("last.observed_at")).alias("forecast_1h"),
    )


def coverage_report(scores: DataFrame) -> DataFrame:
    """One row: cafes, and how many of them are covered, fringe and uncovered."""
    return scores.agg(F.count(F.lit(1)).alias("cafes"), *[F.count_if(F.col("coverage") == c).alias(c) for c in ("covered", "fringe", "uncovered")])

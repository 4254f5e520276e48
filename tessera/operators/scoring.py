"""Point scores from nearby observations, and what is derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.timing import half_up_level, minutes_between
from tessera.operators.spatial import nearest_at
from tessera.operators.temporal import latest
from tessera.params import Capacity, ConfidenceWeights, PointScore


def latest_polled(snapshots: DataFrame, hotspots: DataFrame) -> DataFrame:
    """The latest snapshot of each polled hotspot, with its place as p_lat and p_lng."""
    polled = hotspots.where("is_polled").select("hotspot_id", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    return latest(snapshots.join(polled, "hotspot_id"), "hotspot_id", "observed_at", "event_id")


def weighted(near: DataFrame, keys: Sequence[str], p: PointScore = PointScore(), contributors: bool = False) -> DataFrame:
    """What a score is made of, for each key of near (rank, hotspot_id, distance_m, level, observed_at): one aggregation.

    With contributors, also the array of (hotspot_id, distance_m, level,
    weight), nearest first; weights sum to one.
    """
    near = near.withColumn("_w", 1.0 / F.pow(F.greatest(F.col("distance_m"), F.lit(p.floor_m)), 2.0))
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    parts = [F.sort_array(F.collect_list(F.struct("rank", "hotspot_id", "distance_m", "level", "_w"))).alias("_parts"), F.sum("_w").alias("_sum")] if contributors else []
    made = near.groupBy(*keys).agg(
        (F.sum(F.col("_w") * F.col("level")) / F.sum("_w")).alias("score"),
        F.count(F.lit(1)).cast("int").alias("neighbours"),
        F.max("observed_at").alias("_newest"),
        first("distance_m").alias("primary_distance_m"),
        first("hotspot_id").alias("primary_hotspot_id"),
        first("observed_at").alias("source_observed_at"),
        *parts,
    )
    if not contributors:
        return made
    item = lambda x: F.struct(x.hotspot_id.alias("hotspot_id"), x.distance_m.alias("distance_m"), x.level.alias("level"), (x._w / F.col("_sum")).alias("weight"))
    return made.withColumn("contributors", F.transform("_parts", item)).drop("_parts", "_sum")


def rated(points: DataFrame, made: DataFrame, keys: Sequence[str], now: Column, p: PointScore = PointScore(), on: Sequence[str] | None = None) -> DataFrame:
    """points (keys) with their scores, levels, coverage and confidence out of made, met by keys or by the columns on; without neighbours uncovered."""
    d = F.col("primary_distance_m")
    age = F.greatest(F.lit(0.0), minutes_between(now, F.col("_newest")))
    close = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - d / p.radius_m))
    made = made.withColumn("confidence", close * F.exp(-age / p.tau_min) * F.least(F.lit(1.0), F.col("neighbours") / 2.0))
    tier = F.when(F.col("confidence") >= p.high, "high").when(F.col("confidence") >= p.mid, "medium").when(F.col("confidence").isNotNull(), "low")
    coverage = F.when(d.isNull(), "uncovered").when(d <= p.covered_m, "covered").otherwise("fringe")
    at = list(on or keys)
    out = points.select(*dict.fromkeys([*keys, *at])).join(made, at, "left")
    more = ["contributors"] if "contributors" in made.columns else []
    return out.select(*keys, "score", half_up_level(F.col("score")).alias("level"), coverage.alias("coverage"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"), "confidence", tier.alias("tier"), "primary_hotspot_id", "primary_distance_m", "source_observed_at", *more)


def score_points(points: DataFrame, observations: DataFrame, now: Column, p: PointScore = PointScore(), contributors: bool = False) -> DataFrame:
    """A row for each point (cafe_id, lat, lng) from observations (hotspot_id, p_lat, p_lng, level, observed_at).

    The k nearest within the radius are weighted by the inverse square of
    their distance, floored. Coverage goes by the nearest; confidence by its
    distance, the age of the newest of the k and their number, a single one
    giving half at most. source_observed_at is the nearest one's. A point
    without neighbours is uncovered and has nulls otherwise. With
    contributors, those are a column, too. A score is found once for each
    spot, and met by the points there.
    """
    near = nearest_at(points, observations, "hotspot_id", p.radius_m, p.neighbours)
    return rated(points, weighted(near, ["lat", "lng"], p, contributors), ["cafe_id"], now, p, ["lat", "lng"])


def cycle_health(saved: Column, targets: Column, status: Column, w: ConfidenceWeights = ConfidenceWeights()) -> Column:
    """The share of targets that a cycle saved, by its status: complete, partial or failed; another status is an error."""
    factor = F.when(status == "complete", 1.0).when(status == "partial", w.partial).when(status == "failed", 0.0)
    share = F.when(targets > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), saved / targets))).otherwise(0.0)
    return share * F.coalesce(factor, F.raise_error(F.lit("unknown cycle status")).cast("double"))


def confidence_v2(contributors: DataFrame, now: Column, health: Column, radius_m: float = 1500.0, tau_min: float = 15.0, w: ConfidenceWeights = ConfidenceWeights(), samples: Column | None = None, keys: Sequence[str] = ("cafe_id",)) -> DataFrame:
    """Four parts of confidence for each cafe_id, or each of other keys, of contributors (distance_m, weight, level, observed_at).

    health, the same for all rows, is that of the last cycle. A column inside,
    if there is one, marks contributors whose area holds the cafe: then the
    spatial part is 1. An observation further in the future than skew_min is
    an error. sufficiency, the share of validation samples that are wanted,
    is reported if samples is given and never enters the confidence.
    """
    signed = minutes_between(now, F.col("observed_at"))
    fail = F.raise_error(F.lit("observed in the future")).cast("double")
    age = F.when(signed < -w.skew_min, fail).otherwise(F.greatest(F.lit(0.0), signed))
    share = F.col("weight")
    level = F.col("level") - 2.5  # levels are 1 to 4: centred, squares lose no digits
    inside = F.max("inside") if "inside" in contributors.columns else F.lit(False)
    parts = contributors.groupBy(*keys).agg(
        F.greatest(F.lit(0.0), 1.0 - F.min("distance_m") / radius_m).alias("_near"),
        F.coalesce(inside, F.lit(False)).alias("_inside"),
        (F.sum(share * F.exp(-age / tau_min)) / F.sum(share)).alias("freshness"),
        (F.sum(share * level) / F.sum(share)).alias("_mean"),
        (F.sum(share * level * level) / F.sum(share)).alias("_square"),
        (minutes_between(F.max("observed_at"), F.min("observed_at"))).alias("_span"),
        F.count(F.lit(1)).alias("_n"),
        F.max(health).alias("health"),
        F.max(samples if samples is not None else F.lit(None).cast("double")).alias("_samples"),
    )
    spatial = F.when(F.col("_inside"), 1.0).otherwise(F.col("_near"))
    sigma = F.sqrt(F.greatest(F.lit(0.0), F.col("_square") - F.col("_mean") * F.col("_mean")))
    together = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - sigma / 1.5)) * F.exp(-F.col("_span") / w.tau_align_min)
    agreement = F.when(F.col("_n") == 1, F.lit(w.single)).otherwise(together)
    weights = w.spatial + w.freshness + w.agreement + w.health
    total = (w.spatial * spatial + w.freshness * F.col("freshness") + w.agreement * agreement + w.health * F.col("health")) / weights
    sufficiency = F.least(F.lit(1.0), F.col("_samples") / w.samples)
    return parts.select(*keys, spatial.alias("spatial"), "freshness", agreement.alias("agreement"), "health", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("confidence"), sufficiency.alias("sufficiency"))


def capacity_pressure(demand: Column, area: Column, p: Capacity = Capacity()) -> Column:
    """Demand scaled by the root of the reference area over the place's own, floored."""
    return demand * F.pow(p.reference_area / F.greatest(area, F.lit(p.floor_area)), F.lit(p.alpha))

"""Scores as they stood at the time of each observation in the field, and how well they agree with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.operators.scoring import rated, weighted
from tessera.operators.spatial import nearest_k, radius_pairs
from tessera.operators.temporal import as_of
from tessera.params import PointScore


def first_known(places: DataFrame, place: str, since: str, k: int) -> DataFrame:
    """Of the places at one spot (p_lat, p_lng), those that can at any moment be among the first k known by then; a place is known from since on.

    A place known no earlier than one before it is hidden by that. Those that
    nothing hides make a layer; without them the next one shows. One hidden by
    fewer than k others lies in the first k layers, and these are kept.
    """
    before = Window.partitionBy("p_lat", "p_lng").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    rows = places.withColumn("_kept", F.lit(False))
    for _ in range(k):
        rows = rows.withColumn("_least", F.min(F.when(~F.col("_kept"), F.col(since))).over(before))
        rows = rows.withColumn("_kept", F.col("_kept") | F.col("_least").isNull() | (F.col(since) < F.col("_least")))
    return rows.where("_kept").drop("_kept", "_least")


def scores_as_of(asked: DataFrame, cafes: DataFrame, hotspots: DataFrame, snapshots: DataFrame, p: PointScore = PointScore(), slice_hours: float = 24.0) -> DataFrame:
    """The score of each (cafe_id, observed_at) of asked from what was observed and fetched by then.

    Spots of cafes meet the polled hotspots within the radius once, whatever
    the number of moments; of the hotspots with an observation by then, the
    nearest count, and only these are looked up, each hotspot and moment once.
    A cafe that isn't in cafes gives no row.
    """
    keys = ["cafe_id", "observed_at"]
    moments = asked.select(*keys).distinct().join(cafes.select("cafe_id", "lat", "lng"), "cafe_id")
    spots = moments.select("lat", "lng", "observed_at").distinct()
    polled = hotspots.where("is_polled").select("hotspot_id", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    history = snapshots.select("hotspot_id", "event_id", "level", F.col("observed_at").alias("seen_at"), "fetched_at")
    since = history.where("seen_at IS NOT NULL AND fetched_at IS NOT NULL").groupBy("hotspot_id").agg(F.min(F.greatest("seen_at", "fetched_at")).alias("_since"))
    places = first_known(polled.join(since, "hotspot_id"), "hotspot_id", "_since", p.neighbours)
    pairs = radius_pairs(spots.select("lat", "lng").distinct(), places, p.radius_m).select("lat", "lng", "hotspot_id", "distance_m", "_since")
    at = ["lat", "lng", "observed_at"]
    near = nearest_k(spots.join(pairs, ["lat", "lng"]).where(F.col("_since") <= F.col("observed_at")), at, "hotspot_id", p.neighbours)
    seen = as_of(near.select("hotspot_id", "observed_at"), history, "hotspot_id", "observed_at", "seen_at", "fetched_at", "event_id", slice_hours).where("seen_at IS NOT NULL")
    met = near.join(seen.select("hotspot_id", "observed_at", "level", "seen_at"), ["hotspot_id", "observed_at"])
    made = weighted(met.withColumnsRenamed({"observed_at": "at", "seen_at": "observed_at"}), ["lat", "lng", "at"], p)
    return rated(moments.withColumnRenamed("observed_at", "at"), made, ["cafe_id", "at"], F.col("at"), p, ["lat", "lng", "at"]).withColumnRenamed("at", "observed_at")


def evaluated(truths: DataFrame, scores: DataFrame, truth: str = "truth") -> DataFrame:
    """truths (cafe_id, observed_at, slot and the level truth) with score, level and coverage; unscored ones have nulls there."""
    return truths.join(scores.select("cafe_id", "observed_at", "score", F.when(F.col("score").isNotNull(), F.col("level")).alias("level"), "coverage"), ["cafe_id", "observed_at"], "left")


def summarize(points: DataFrame, truth: str = "truth", least: int = 2) -> DataFrame:
    """One row over evaluated points: how many there are, uncovered and predicted, the mean of the slots' rank correlations, and the share of levels at most one off.

    Points without a slot count for levels only; slots without a correlation
    are left out of the mean, which is null if none has one.
    """
    predicted = points.where(F.col("score").isNotNull() & F.col("level").isNotNull() & F.col(truth).isNotNull())
    rho = stats.spearman(predicted.where("slot <> ''"), ["slot"], "score", truth, least).agg(F.avg("rho").alias("spearman"), F.count("rho").alias("slots"))
    near = (F.abs(F.col("level") - F.col(truth)) <= 1).cast("double")
    counts = points.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("coverage") == "uncovered").alias("uncovered"))
    done = predicted.agg(F.count(F.lit(1)).alias("observations"), F.avg(near).alias("adjacent_accuracy"))
    return counts.crossJoin(done).crossJoin(rho)  # a row each


def reliability(observations: DataFrame, role: Column, order: Column) -> DataFrame:
    """One row: pairs, and the weighted kappa between two observers of a cafe and slot.

    role is primary or reliability; of several rows of a role the first by
    order counts. Cafes and slots with one role alone have no pair.
    """
    first = lambda name: F.min_by("level", F.when(role == name, order)).alias(name)
    pairs = observations.groupBy("cafe_id", F.coalesce("slot", F.lit("")).alias("slot")).agg(first("primary"), first("reliability"))
    pairs = pairs.where("primary IS NOT NULL AND reliability IS NOT NULL").withColumn("all", F.lit(1))
    n = pairs.agg(F.count(F.lit(1)).alias("pairs"))
    return n.join(stats.weighted_kappa(pairs, ["all"], "primary", "reliability").select("kappa"), how="left")

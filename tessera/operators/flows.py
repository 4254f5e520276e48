"""Origin-destination flows: balances, directions and purposes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.geo import bearing_parts, degrees_of


def net_flow(flows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each zone and hour: inbound by arrival hour, outbound by departure hour, net, and intrazonal flow.

    Columns in by, such as a date, divide the flows further.
    """
    inbound = flows.groupBy(*by, F.col("destination_id").alias("zone_id"), F.col("arrival_hour").alias("hour")).agg(F.sum("flow").alias("inbound"), F.sum(F.when(F.col("origin_id") == F.col("destination_id"), F.col("flow")).otherwise(0.0)).alias("intrazonal"))
    outbound = flows.groupBy(*by, F.col("origin_id").alias("zone_id"), F.col("departure_hour").alias("hour")).agg(F.sum("flow").alias("outbound"))
    both = inbound.join(outbound, [*by, "zone_id", "hour"], "full_outer").na.fill(0.0, ["inbound", "outbound", "intrazonal"])
    return both.withColumn("net", F.col("inbound") - F.col("outbound")).where("inbound + outbound > 0")


def direction(flows: DataFrame, centroids: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """For each destination and arrival hour: share of inbound flow with known places, strength and mean bearing.

    Flow inside a zone is left out. Bearings are found once for each pair of
    zones; opposite flows that cancel have strength 0 and no bearing. Columns in
    by divide the flows further.
    """
    a = centroids.select(F.col("zone_id").alias("origin_id"), F.col("lat").alias("_a"), F.col("lng").alias("_b"))
    b = centroids.select(F.col("zone_id").alias("destination_id"), F.col("lat").alias("_c"), F.col("lng").alias("_d"))
    east, north = bearing_parts(F.col("_a"), F.col("_b"), F.col("_c"), F.col("_d"))
    moved = flows.where("origin_id <> destination_id").groupBy(*by, "origin_id", "destination_id", F.col("arrival_hour").alias("hour")).agg(F.sum("flow").alias("flow"))
    pairs = moved.select("origin_id", "destination_id").distinct().join(a, "origin_id", "left").join(b, "destination_id", "left").select("origin_id", "destination_id", east.alias("east"), north.alias("north"))
    rows = moved.join(pairs, ["origin_id", "destination_id"])
    known = F.when(F.col("east").isNotNull(), F.col("flow")).otherwise(0.0)
    sums = rows.groupBy(*by, F.col("destination_id").alias("zone_id"), "hour").agg(F.sum("flow").alias("eligible"), F.sum(known).alias("_known"), F.sum(known * F.coalesce("east", F.lit(0.0))).alias("_e"), F.sum(known * F.coalesce("north", F.lit(0.0))).alias("_n"))
    size = F.hypot("_e", "_n")
    strength = F.when(F.col("_known") > 0, F.least(F.lit(1.0), size / F.col("_known")))
    return sums.select(*by, "zone_id", "hour", "eligible", (F.col("_known") / F.col("eligible")).alias("coverage"), strength.alias("strength"), F.when(strength > 1e-9, degrees_of(F.col("_e"), F.col("_n"))).alias("bearing"))

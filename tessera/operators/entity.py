"""Matching of catalogues, one to one or not at all."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.spatial import radius_pairs
from tessera.params import Reconcile


def candidate_pairs(a: DataFrame, b: DataFrame, p: Reconcile = Reconcile()) -> DataFrame:
    """Pairs (a_id, b_id, by_name, by_phone, distance_m) of (place_id, norm_name, phone, lat, lng) that agree nearby.

    Names have to agree within name_m, phones within phone_m. Rows meet in
    cells as wide as the larger bound.
    """
    left = a.select(F.col("place_id").alias("a_id"), F.col("norm_name").alias("a_name"), F.col("phone").alias("a_phone"), "lat", "lng")
    right = b.select(F.col("place_id").alias("b_id"), F.col("norm_name").alias("b_name"), F.col("phone").alias("b_phone"), F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"))
    pairs = radius_pairs(left, right, max(p.name_m, p.phone_m))
    name = F.coalesce((F.col("a_name") == F.col("b_name")) & (F.col("distance_m") <= p.name_m), F.lit(False))
    phone = F.coalesce((F.col("a_phone") == F.col("b_phone")) & (F.col("distance_m") <= p.phone_m), F.lit(False))
    return pairs.select("a_id", "b_id", name.alias("by_name"), phone.alias("by_phone"), "distance_m").where("by_name OR by_phone")


def reconcile(pairs: DataFrame) -> DataFrame:
    """Adds rule (both, name or phone) and status: verified if neither side has another pair, else ambiguous."""
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    rule = F.when(F.col("by_name") & F.col("by_phone"), "both").when(F.col("by_name"), "name").otherwise("phone")
    counted = pairs.withColumn("_a", n("a_id")).withColumn("_b", n("b_id"))
    return counted.select("a_id", "b_id", "distance_m", rule.alias("rule"), F.when((F.col("_a") == 1) & (F.col("_b") == 1), "verified").otherwise("ambiguous").alias("status"))


def two_signals(a: DataFrame, b: DataFrame, signals: list[str], least: int = 2) -> DataFrame:
    """Pairs (a_id, b_id, n_signals, status) that share at least so many signals.

    Rows meet by an equality join for each choice of least signals, so what
    a chain's places share, such as their name, makes no pairs by itself. An
    id claimed by two partners makes all its claimants ambiguous.
    """
    left = a.select(F.col("place_id").alias("a_id"), *(F.col(s).alias(f"_a_{s}") for s in signals))
    right = b.select(F.col("place_id").alias("b_id"), *(F.col(s).alias(f"_b_{s}") for s in signals))
    shared = sum((F.coalesce(F.col(f"_a_{s}") == F.col(f"_b_{s}"), F.lit(False)).cast("int") for s in signals), F.lit(0))
    found = None
    for chosen in combinations(signals, least):
        met = left.join(right, [F.col(f"_a_{s}") == F.col(f"_b_{s}") for s in chosen]).select("a_id", "b_id", shared.alias("n_signals"))
        found = met if found is None else found.union(met)
    found = found.groupBy("a_id", "b_id").agg(F.max("n_signals").alias("n_signals"))
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    return found.withColumn("status", F.when((n("a_id") > 1) | (n("b_id") > 1), "ambiguous").otherwise("verified"))


def release_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str], tolerance: float = 0.0, close: tuple[str, ...] = ()) -> DataFrame:
    """Each key's change (insert, update, unchanged, deactivate) and n_changed fields; nulls equal nulls.

    Fields named in close are equal within the tolerance.
    """
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in fields]).withColumn("_old", F.lit(True))
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in fields]).withColumn("_new", F.lit(True))

    def differs(c: str) -> Column:
        x, y = F.col(f"_o_{c}"), F.col(f"_n_{c}")
        if c in close:
            return ~F.coalesce(F.abs(x - y) <= tolerance, x.isNull() & y.isNull())
        return ~x.eqNullSafe(y)

    changed = sum((differs(c).cast("int") for c in fields), F.lit(0))
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    kind = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "deactivate").when(changed > 0, "update").otherwise("unchanged")
    return o.join(n, key, "full_outer").select(key, kind.alias("change"), F.when(both, changed).otherwise(0).alias("n_changed"))


def staged_links(spatial: DataFrame, identity: DataFrame) -> DataFrame:
    """Rows (a_id, b_id, stage): verified pairs of spatial first, then those of identity among ids not used yet."""
    first = spatial.where("status = 'verified'").select("a_id", "b_id", F.lit("spatial").alias("stage"))
    rest = identity.where("status = 'verified'").join(first.select("a_id"), "a_id", "left_anti").join(first.select("b_id"), "b_id", "left_anti")
    return first.union(rest.select("a_id", "b_id", F.lit("identity").alias("stage")))


def expansion(candidates: DataFrame, existing: DataFrame, key: str, conflict: list[str], peer: list[str]) -> DataFrame:
    """Each candidate's status: blocked if an existing row agrees in conflict, else admitted, with peers.

    peers counts other candidates that agree in the peer columns; it is
    advice and never blocks.
    """
    blocked = existing.select(*conflict).distinct().withColumn("_hit", F.lit(True))
    known = candidates.select(*peer).where(" AND ".join(f"`{c}` IS NOT NULL" for c in peer))
    n = known.groupBy(*peer).agg((F.count(F.lit(1)) - 1).alias("_peers"))  # rows without a peer column meet nothing
    joined = candidates.join(n, peer, "left").join(blocked, conflict, "left")
    return joined.select(key, F.when(F.col("_hit"), "blocked").otherwise("admitted").alias("status"), F.coalesce("_peers", F.lit(0)).alias("peers"))


def exact_links(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Pairs (a_id, b_id) that agree in all columns, where neither id has another partner."""
    pairs = a.select(F.col("place_id").alias("a_id"), *on).join(b.select(F.col("place_id").alias("b_id"), *on), on).select("a_id", "b_id").distinct()
    n = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c))
    return pairs.withColumn("_a", n("a_id")).withColumn("_b", n("b_id")).where("_a = 1 AND _b = 1").drop("_a", "_b")

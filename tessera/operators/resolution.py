"""Permits and cafes that are one place, proven strictly, and catalogues built in stages on such proofs."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.address import road_address, with_entity_text
from tessera.functions.geo import haversine_m
from tessera.functions.text import digits
from tessera.operators.entity import candidate_pairs, reconcile, two_signals
from tessera.operators.spatial import cube_pairs, keyed_pairs
from tessera.params import Reconcile

MAX_M = 50.0
SIGNALS = ("name", "address", "structured", "phone")


def usable_phone(text: Column, least: int = 9) -> Column:
    """Digits of a text of digits and common separators with enough of them; null otherwise."""
    return F.when(text.rlike(r"^[0-9+().\s-]+$") & (F.length(digits(text)) >= least), digits(text))


def comparable(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """(key, lat, lng) and the comparable forms prefix_name, _address, _structured and _phone of df's name, address and phone."""
    made = with_entity_text(with_entity_text(df, "name", f"{prefix}_name"), "address", f"{prefix}_address")
    made = made.withColumn(f"{prefix}_structured", road_address(F.col(f"{prefix}_address"))).withColumn(f"{prefix}_phone", usable_phone(F.col("phone")))
    return made.select(key, F.col("lat").alias(f"{prefix}_lat"), F.col("lng").alias(f"{prefix}_lng"), *(f"{prefix}_{s}" for s in SIGNALS))


def strong_pairs(permits: DataFrame, cafes: DataFrame, within_m: float = MAX_M) -> DataFrame:
    """(permit_id, cafe_id, by_name, by_phone, distance_m) of pairs with one structured address, near, and one name or phone.

    They meet by address and name, and by address and phone, so what many
    tenants of one building share makes no pairs by itself.
    """
    p, c = comparable(permits, "permit_id", "p"), comparable(cafes, "cafe_id", "c")
    same = F.col("p_structured").eqNullSafe(F.col("c_structured"))
    d = haversine_m(F.col("p_lat"), F.col("p_lng"), F.col("c_lat"), F.col("c_lng"))
    flag = lambda s: F.coalesce(F.col(f"p_{s}") == F.col(f"c_{s}"), F.lit(False)).alias(f"by_{s}")
    # a hash of the whole struct is the key to meet by; the struct itself decides
    keyed = lambda df, x: df.where(f"{x}_structured IS NOT NULL").withColumn(f"{x}_at", F.xxhash64(f"{x}_structured"))
    found = None
    for s in ("name", "phone"):
        met = keyed(p, "p").join(keyed(c, "c"), (F.col("p_at") == F.col("c_at")) & (F.col(f"p_{s}") == F.col(f"c_{s}")) & same)
        met = met.select("permit_id", "cafe_id", flag("name"), flag("phone"), d.alias("distance_m")).where(F.col("distance_m") <= within_m)
        found = met if found is None else found.union(met)
    return found.distinct()


def resolve_strictly(permits: DataFrame, cafes: DataFrame, within_m: float = MAX_M) -> DataFrame:
    """Each permit (permit_id, name, address, phone, lat, lng) as verified, missing or ambiguous against cafes (cafe_id and the same).

    A cafe is strong evidence if both road addresses parse to equal parts, it
    lies within within_m, and name or phone agrees. One strong cafe verifies, none
    is missing, more are ambiguous. Where several permits would verify one
    cafe, all of them are ambiguous and collide; no winner is guessed. Columns:
    permit_id, status, cafe_id (if verified), rule (both, name_only or
    phone_only), distance_m, strong and collides. Ids must not repeat.
    """
    pairs = strong_pairs(permits, cafes, within_m)
    rule = F.when(F.col("by_name") & F.col("by_phone"), "both").when(F.col("by_name"), "name_only").otherwise("phone_only")
    best = F.min(F.struct("cafe_id", rule.alias("rule"), "distance_m")).alias("b")
    strong = pairs.groupBy("permit_id").agg(F.count(F.lit(1)).alias("strong"), best)
    claims = strong.where("strong = 1").groupBy(F.col("b.cafe_id").alias("claimed")).agg(F.count(F.lit(1)).alias("claims"))
    judged = strong.join(claims, (F.col("strong") == 1) & (F.col("b.cafe_id") == F.col("claimed")), "left")
    collides = F.coalesce(F.col("claims") > 1, F.lit(False))
    out = permits.select("permit_id").join(judged.withColumn("collides", collides), "permit_id", "left")
    status = F.when(F.col("strong").isNull(), "missing").when((F.col("strong") == 1) & ~F.col("collides"), "verified").otherwise("ambiguous")
    of = lambda c: F.when(F.col("status") == "verified", F.col(f"b.{c}")).alias(c)
    return out.withColumn("status", status).select("permit_id", "status", of("cafe_id"), of("rule"), of("distance_m"), F.coalesce("strong", F.lit(0)).alias("strong"), F.coalesce("collides", F.lit(False)).alias("collides"))


# The gates of the funnel in the order in which they are reported, each with what has to hold.
GATES = {
    "grid_nearby": (),
    "actual_within_distance_gate": ("near",),
    "exact_normalized_name_within_distance_gate": ("near", "name"),
    "exact_normalized_address_within_distance_gate": ("near", "address"),
    "exact_structured_address_within_distance_gate": ("near", "structured"),
    "exact_normalized_phone_within_distance_gate": ("near", "phone"),
    "exact_normalized_address_and_name_within_distance_gate": ("near", "address", "name"),
    "exact_normalized_address_and_phone_within_distance_gate": ("near", "address", "phone"),
    "exact_name_and_phone_within_distance_gate": ("near", "name", "phone"),
    "exact_structured_address_and_name_within_distance_gate": ("near", "structured", "name"),
    "exact_structured_address_and_phone_within_distance_gate": ("near", "structured", "phone"),
}


def gate_masks(permits: DataFrame, cafes: DataFrame, own_source: str, within_m: float = MAX_M) -> DataFrame:
    """(stage, permit_id, pairs): how many cafes in neighbouring cubes pass gate number stage of GATES with a permit, where any do.

    Cafes whose origin_provider is own_source, the permits' own, don't count.
    No pair of a permit and a cafe is made. Both are counted by spot and by what a
    gate compares, and what is equal in that meets once for two spots, so the
    tenants of one building cost as much as their number.
    """
    others = cafes.where(~F.col("origin_provider").eqNullSafe(F.lit(own_source)))
    n = F.count(F.lit(1)).alias("n")
    at = permits.select("permit_id", "lat", "lng")
    cafes_at = others.groupBy(F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng")).agg(n)
    near = haversine_m(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng")) <= within_m
    spots = cube_pairs(at.select("lat", "lng").distinct(), cafes_at, within_m)
    spots = spots.groupBy("lat", "lng").agg(F.sum("n").alias("n0"), F.sum(F.when(near, F.col("n"))).alias("n1"))
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("stage"), F.col(f"n{i}").alias("pairs")) for i in (0, 1)]))
    bare = at.join(spots, ["lat", "lng"]).select("permit_id", each).where("pairs > 0")

    # rows are few to a split, and what is made of them is much more
    p = comparable(permits.repartition("permit_id"), "permit_id", "p").withColumnsRenamed({"p_lat": "lat", "p_lng": "lng"})
    c = comparable(others.repartition("cafe_id"), "cafe_id", "c").withColumnsRenamed({"c_lat": "p_lat", "c_lng": "p_lng"})
    kinds = {s: p.schema[f"p_{s}"].dataType for s in SIGNALS}

    def keys(x: str) -> Column:
        """One value for each gate with signals, none of which is null: its stage and what it compares."""
        made = []
        for i, needs in enumerate(GATES.values()):
            if used := [s for s in needs if s in SIGNALS]:
                values = [(F.col(f"{x}_{s}") if s in used else F.lit(None).cast(kind)).alias(s) for s, kind in kinds.items()]
                made.append(F.when(reduce(and_, [F.col(f"{x}_{s}").isNotNull() for s in used]), F.struct(F.lit(i).alias("stage"), *values)))
        return F.explode(F.array_compact(F.array(*made))).alias("key")

    signed = p.select("permit_id", "lat", "lng", keys("p"))
    groups = c.select("p_lat", "p_lng", keys("c")).groupBy("key", "p_lat", "p_lng").agg(n)
    met = keyed_pairs(signed.select("key", "lat", "lng").distinct(), groups, "key", within_m).groupBy("key", "lat", "lng").agg(F.sum("n").alias("pairs"))
    return bare.unionByName(signed.hint("merge").join(met, ["key", "lat", "lng"]).select("permit_id", "key.stage", "pairs"))


def gate_funnel(counts: DataFrame) -> DataFrame:
    """(stage, gate, pairs, permits): how many pairs pass each gate, and permits with any such pair, from the rows of gate_masks."""
    names = F.inline(F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(g).alias("gate")) for i, g in enumerate(GATES)]))
    by_stage = counts.groupBy("stage").agg(F.sum("pairs").alias("pairs"), F.count_distinct("permit_id").alias("permits"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counts.sparkSession.range(1).select(names).join(by_stage, "stage", "left").select("stage", "gate", zero("pairs"), zero("permits"))


def eligible_area(category: Column, status: Column, unit: Column, unit_status: Column, area: Column, wanted: tuple[str, str, str, str]) -> Column:
    """The area as a decimal if category, status, unit and its status are those wanted and it is positive; null otherwise."""
    ok = (category == wanted[0]) & (status == wanted[1]) & (unit == wanted[2]) & (unit_status == wanted[3])
    number = area.cast("string").try_cast("decimal(38,9)")
    return F.when(F.coalesce(ok, F.lit(False)) & (number > 0), number)


def coverage_report(resolved: DataFrame, areas: DataFrame, cafes: DataFrame, percentiles: tuple[int, ...] = (1, 5, 50, 95, 99)) -> DataFrame:
    """One row about resolved permits: numbers by status and rule, collisions, and nearest-rank percentiles of verified areas (permit_id, area)."""
    rows = resolved.join(areas, "permit_id", "left").join(cafes.select("cafe_id", "origin_provider"), "cafe_id", "left")
    sure = F.col("status") == "verified"
    states = [F.count_if(F.col("status") == s).alias(s) for s in ("verified", "missing", "ambiguous")]
    rules = [F.count_if(sure & (F.col("rule") == r)).alias(r) for r in ("name_only", "phone_only", "both")]
    collided = [F.count_if("collides").alias("colliding_permits")]
    area = [F.min(F.when(sure, F.col("area"))).alias("area_min"), F.max(F.when(sure, F.col("area"))).alias("area_max")]
    rank = [F.expr(f"percentile_disc({q / 100}) WITHIN GROUP (ORDER BY CASE WHEN status = 'verified' THEN area END)").alias(f"area_p{q}") for q in percentiles]
    return rows.agg(F.count(F.lit(1)).alias("permits"), *states, *rules, *collided, F.count_distinct(F.when(sure, F.col("origin_provider"))).alias("providers"), *area, *rank)


def provider_catalogue(first: DataFrame, permits: DataFrame, provider: DataFrame, p: Reconcile = Reconcile()) -> tuple[DataFrame, DataFrame]:
    """A provider's places given to two catalogues in three stages, and what came of each.

    All have (place_id, norm_name, phone, lat, lng). The provider's places are
    first matched with the first catalogue by place and name or phone; those
    left that weren't ambiguous, with permits; and those left again, with what
    is left of the first, by name and phone alone. An id is used once at most.
    Returns (source, source_id, provider_id, stage, rule, distance_m) and
    (stage, matched, ambiguous, unmatched), numbers of the provider's places.
    """
    n = lambda df, c: df.select(c).distinct()
    spatial = reconcile(candidate_pairs(provider, first, p))
    sure1, vague1 = spatial.where("status = 'verified'"), spatial.where("status = 'ambiguous'")
    met1 = n(spatial, "a_id")
    rest = provider.join(met1.withColumnRenamed("a_id", "place_id"), "place_id", "left_anti")
    second = reconcile(candidate_pairs(permits, rest, p))
    sure2 = second.where("status = 'verified'")
    left = rest.join(n(sure2, "b_id").withColumnRenamed("b_id", "place_id"), "place_id", "left_anti")
    open_first = first.join(n(sure1, "b_id").withColumnRenamed("b_id", "place_id"), "place_id", "left_anti")
    third = two_signals(open_first, left, ["norm_name", "phone"])
    sure3 = third.where("status = 'verified'")
    place = lambda df: df.select(F.col("place_id").alias("_id"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng"))
    far = sure3.join(place(first), F.col("a_id") == F.col("_id")).drop("_id").join(left.select(F.col("place_id").alias("_b"), "lat", "lng"), F.col("b_id") == F.col("_b"))
    refs = sure1.select(F.lit("first").alias("source"), F.col("b_id").alias("source_id"), F.col("a_id").alias("provider_id"), F.lit("spatial").alias("stage"), "rule", "distance_m")
    refs = refs.union(sure2.select(F.lit("permit"), F.col("a_id"), F.col("b_id"), F.lit("permit"), "rule", "distance_m"))
    refs = refs.union(far.select(F.lit("first"), F.col("a_id"), F.col("b_id"), F.lit("identity"), F.lit("identity"), haversine_m(F.col("_lat"), F.col("_lng"), F.col("lat"), F.col("lng"))))
    size = lambda stage, whole, sure, vague, c: whole.agg(F.count(F.lit(1)).alias("all")).crossJoin(n(sure, c).agg(F.count(F.lit(1)).alias("matched"))).crossJoin(n(vague.join(n(sure, c), c, "left_anti"), c).agg(F.count(F.lit(1)).alias("ambiguous"))).select(F.lit(stage).alias("stage"), "matched", "ambiguous", (F.col("all") - F.col("matched") - F.col("ambiguous")).alias("unmatched"))  # noqa: E731  a row each
    report = size("spatial", provider, sure1, vague1, "a_id").union(size("permit", rest, sure2, second.where("status = 'ambiguous'"), "b_id")).union(size("identity", left, sure3, third.where("status = 'ambiguous'"), "b_id"))
    return refs, report


def shared_owners(refs: DataFrame) -> DataFrame:
    """Provider ids that several sources claim, with how many; a catalogue in which there is one must not be published."""
    w = Window.partitionBy("provider_id")
    return refs.withColumn("owners", F.count(F.lit(1)).over(w)).where("owners > 1")

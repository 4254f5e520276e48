"""Checks, comparisons and summaries over the domain's tables; their SQL stands beside the subjects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.timing import freshness
from tessera.operators import audit, stats, temporal
from tessera.plans.registry import query
from tessera.plans.scores import now, observations
from tessera.sources.adapters import load


def tables(spark, sf_dir, *names):
    return [load(spark, sf_dir, n) for n in names]


def by_purpose(spark, sf_dir):
    return load(spark, sf_dir, "od_flows").groupBy(F.col("destination_id").alias("zone_id"), "purpose")


def located(spark, sf_dir):
    """Flows with the places of both ends, null where there is none."""
    f, c = tables(spark, sf_dir, "od_flows", "od_centroids")
    o = c.select(F.col("zone_id").alias("origin_id"), F.col("lat").alias("o_lat"))
    d = c.select(F.col("zone_id").alias("destination_id"), F.col("lat").alias("d_lat"))
    return f.join(o, "origin_id", "left").join(d, "destination_id", "left")


@query()
def od_coverage(spark, sf_dir):
    inside = F.col("origin_id") == F.col("destination_id")
    return located(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("origin_id").alias("origins"), F.count_if(F.col("o_lat").isNull() | F.col("d_lat").isNull()).alias("uncovered"), F.sum(F.when(inside, F.col("flow")).otherwise(0.0)).alias("intrazonal"))


@query()
def od_missing_codes(spark, sf_dir):
    f, c = tables(spark, sf_dir, "od_flows", "od_centroids")
    return audit.orphans(f.select(F.col("origin_id").alias("zone_id")).distinct(), c, "zone_id")


@query()
def od_centroid_join(spark, sf_dir):
    return located(spark, sf_dir).groupBy("origin_id", "destination_id").agg(F.sum("flow").alias("flow"), F.max("o_lat").alias("o_lat"), F.max("d_lat").alias("d_lat"))


@query()
def od_weighted_means(spark, sf_dir):
    hours = F.abs(F.col("arrival_hour") - F.col("departure_hour"))
    mean, _, _ = stats.weighted_stats(F.col("flow"), hours.cast("double"))
    return load(spark, sf_dir, "od_flows").groupBy("origin_id").agg(F.round(mean, 6).alias("mean_hours"), F.sum("flow").alias("flow"))


@query()
def key_union(spark, sf_dir):
    f = load(spark, sf_dir, "od_flows")
    return f.select(F.col("origin_id").alias("zone_id"), F.col("departure_hour").alias("hour")).union(f.select("destination_id", "arrival_hour")).distinct()


@query()
def complete_zones(spark, sf_dir):
    return audit.complete_keys(load(spark, sf_dir, "od_flows"), "destination_id", "arrival_hour", (7, 8, 9)).withColumnRenamed("destination_id", "zone_id")


@query()
def set_difference(spark, sf_dir):
    f, c = tables(spark, sf_dir, "od_flows", "od_centroids")
    return audit.key_sides(f.select(F.col("origin_id").alias("zone_id")), c, "zone_id").where("side = 'left'").select("zone_id")


@query()
def code_set_diff(spark, sf_dir):
    n, c = tables(spark, sf_dir, "nation", "od_centroids")
    return audit.key_sides(n.select(F.col("n_nationkey").alias("zone_id")), c, "zone_id")


@query()
def paired_stock(spark, sf_dir):
    f = load(spark, sf_dir, "od_flows").select(F.col("destination_id").alias("zone_id"), F.col("flow").alias("stock"), "arrival_hour", "purpose")
    return audit.paired(f.where("arrival_hour = 8 AND purpose = 1"), f.where("arrival_hour = 9 AND purpose = 2"), "zone_id", "stock")


@query()
def jaccard_decile(spark, sf_dir):
    t = by_purpose(spark, sf_dir).agg(F.sum("flow").alias("flow")).where("purpose IN (1, 2)")
    j = audit.jaccard(audit.top_share(t, "purpose", "zone_id", "flow", 0.2), "purpose", "zone_id")
    return j.select(F.col("either").alias("both_sets"), F.col("both").alias("shared_zones"), F.round("jaccard", 9).alias("jaccard"))


@query()
def weekly_pairs(spark, sf_dir):
    return audit.day_pairs(load(spark, sf_dir, "cell_fragments"), "cell_id", "observed_date", 7)


@query()
def validation_counts(spark, sf_dir):
    known = F.col("known_value")
    flags = {"masked_rows": F.col("masked"), "negative": known < 0, "masked_known": F.col("masked") & known.isNotNull(), "bad_hour": ~F.col("hour").between(0, 23)}
    return audit.count_flags(load(spark, sf_dir, "cell_fragments"), flags)


@query()
def dup_fragments(spark, sf_dir):
    """The first key, in order, that stands in several rows."""
    keys = ["cell_id", "observed_date", "hour"]
    return audit.repeated_keys(load(spark, sf_dir, "cell_fragments"), keys).orderBy(*keys).limit(1)


@query()
def mask_summary(spark, sf_dir):
    return audit.mask_states(load(spark, sf_dir, "cell_fragments"), ["cell_id", "observed_date", "hour"])


@query()
def missing_cells(spark, sf_dir):
    n, f = tables(spark, sf_dir, "nation", "cell_fragments")
    return audit.orphans(n.select(F.col("n_nationkey").cast("int").alias("cell_id")), f, "cell_id")


@query()
def allowlist_semi(spark, sf_dir):
    f, r = tables(spark, sf_dir, "cell_fragments", "region")
    allowed = r.where("r_regionkey < 3").select(F.col("r_regionkey").cast("int").alias("cell_id"))
    return f.join(allowed, "cell_id", "left_semi").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"))


@query()
def owner_conflict(spark, sf_dir):
    return audit.owner_conflicts(load(spark, sf_dir, "cell_fragments"), "known_value", "cell_id")


@query()
def provider_matrix(spark, sf_dir):
    c = load(spark, sf_dir, "cafes")
    banded = c.where("active").withColumn("band", F.when(F.col("source_confidence") >= 0.8, "high").otherwise("low"))
    return audit.matrix(banded, c, ["low", "high"], "origin_provider", "band")


@query()
def curated_admission(spark, sf_dir):
    """Cafes of high confidence, or with a match of their own that has a phone."""
    c, b = tables(spark, sf_dir, "cafes", "catalogue_b")
    matched = b.where("phone IS NOT NULL AND place_id < 2000000").select((F.col("place_id") - 1000000).alias("cafe_id"), F.lit(True).alias("m")).distinct()
    sure = F.col("source_confidence") >= 0.8
    return c.join(matched, "cafe_id", "left").where(sure | F.col("m")).select("cafe_id", F.when(sure, "confidence").otherwise("match").alias("reason"))


@query()
def region_gate(spark, sf_dir):
    inside = F.col("lat").between(37.41, 37.72) & F.col("lng").between(126.76, 127.20) & F.col("name").startswith("Customer")
    return load(spark, sf_dir, "cafes").select("cafe_id", inside.alias("inside_region"))


@query()
def exact_dups(spark, sf_dir):
    return audit.exact_repeats(load(spark, sf_dir, "catalogue_b"), ["norm_name", "phone"])


@query()
def conflict_reasons(spark, sf_dir):
    return audit.field_conflicts(load(spark, sf_dir, "catalogue_b"), "norm_name", ["phone", "lat"])


@query()
def latest_by_update(spark, sf_dir):
    return temporal.latest(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")


@query()
def observer_assign(spark, sf_dir):
    t = load(spark, sf_dir, "truths")
    who = F.element_at(F.array(F.lit("a"), F.lit("b")), audit.turns(t, "slot", ["observed_at", "cafe_id"], 2) + 1)
    return t.select("cafe_id", "slot", "observed_at", who.alias("observer"))


@query()
def field_worksheet(spark, sf_dir):
    t = load(spark, sf_dir, "truths")
    return t.select("slot", "cafe_id", audit.turns(t, "slot", ["cafe_id", "observed_at"], 3).alias("rotation"))


@query()
def area_nearest_rank(spark, sf_dir):
    return load(spark, sf_dir, "cafes").groupBy("origin_provider").agg(audit.nearest_rank("source_confidence", 0.5).alias("p50"), audit.nearest_rank("source_confidence", 0.95).alias("p95"))


@query()
def decimal_profile(spark, sf_dir):
    return audit.number_profile(load(spark, sf_dir, "customer"), "c_acctbal", 9000.0)


@query()
def constraint_violations(spark, sf_dir):
    h, s = tables(spark, sf_dir, "hotspots", "snapshots")
    bounds = (F.col("ppltn_min") <= F.col("ppltn_max")) & (F.col("ppltn_min") >= 0)
    none = F.lit(False)  # every row found is one too many
    return audit.violations(
        [
            ("lat", h, F.col("lat").between(-90, 90)),
            ("level", s, F.col("level").between(1, 4)),
            ("bounds", s, bounds),
            ("natural_key", audit.repeated_keys(s, ["hotspot_id", "observed_at"]), none),
            ("orphan", audit.orphans(s, h, "hotspot_id"), none),
        ]
    )


@query()
def angle_diff(spark, sf_dir):
    turn = lambda k: (F.col("n_nationkey") * k % 360).cast("double")
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zone_id"), F.round(audit.angle_gap(turn(47), turn(113)), 6).alias("gap"))


@query()
def aged_state(spark, sf_dir):
    """The state of each observation now and an hour later, without another read."""
    later = now() + F.expr("INTERVAL 1 HOUR")
    seen = F.col("observed_at")
    return load(spark, sf_dir, "snapshots").select("event_id", freshness(seen, now()).alias("now_state"), freshness(seen, later).alias("later_state"))


@query()
def is_open(spark, sf_dir):
    ok = (F.col("o_orderstatus") == "O") & F.col("o_orderpriority").isNotNull() & (F.col("o_totalprice") > 0)
    return load(spark, sf_dir, "orders").select("o_orderkey", ok.alias("is_open"))


@query()
def link_precedence(spark, sf_dir):
    c, b = tables(spark, sf_dir, "cafes", "catalogue_b")
    rows = c.join(b.select((F.col("place_id") - 1000000).alias("cafe_id"), "place_id", "phone"), "cafe_id", "left")
    link = audit.link_of(F.col("place_id").isNotNull(), F.concat(F.lit("row:"), "phone"), F.concat(F.lit("json:"), "name"), F.col("phone").isNotNull())
    return rows.select("cafe_id", link.alias("link"))


def both_catalogues(spark, sf_dir):
    a, b = tables(spark, sf_dir, "catalogue_a", "catalogue_b")
    other = b.select((F.col("place_id") - 1000000).alias("place_id"), *(F.col(c).alias(f"new_{c}") for c in ("norm_name", "phone", "lat")))
    rows = a.join(other, "place_id")
    change = lambda c, within=None: audit.differs(F.col(c), F.col(f"new_{c}"), within)
    return rows, {"names": change("norm_name"), "phones": change("phone"), "places": change("lat", 1e-12)}


@query()
def changed_fields(spark, sf_dir):
    rows, changes = both_catalogues(spark, sf_dir)
    return audit.count_flags(rows, changes, total=None)


@query()
def display_refresh(spark, sf_dir):
    rows, changes = both_catalogues(spark, sf_dir)
    moved = F.round(F.abs(F.col("lat") - F.col("new_lat")) * 111320, 3)
    changed = changes["names"] | changes["phones"] | changes["places"]
    return rows.where(changed).select("place_id", changes["names"].alias("name_changed"), changes["phones"].alias("phone_changed"), moved.alias("moved_m"))


@query()
def catalog_gap_report(spark, sf_dir):
    c, b = tables(spark, sf_dir, "cafes", "catalogue_b")
    rows = c.where("active").join(b.select((F.col("place_id") - 1000000).alias("cafe_id"), "place_id"), "cafe_id", "left")
    g = rows.groupBy("origin_provider").agg(F.count(F.lit(1)).alias("places"), F.count("place_id").alias("linked"))
    return g.withColumn("batches", F.ceil((F.col("places") - F.col("linked")) / 50).cast("int"))


@query()
def density_report(spark, sf_dir):
    v = observations(spark, sf_dir).select(((F.col("ppltn_min") + F.col("ppltn_max")) / 2.0 / 1_000_000).alias("v"))
    r = lambda f: F.round(f("v"), 9)
    return v.agg(F.count(F.lit(1)).alias("n"), r(F.min).alias("least"), r(F.avg).alias("mean"), r(F.median).alias("middle"), r(F.max).alias("most"))


@query()
def url_identity(spark, sf_dir):
    c = load(spark, sf_dir, "cafes")
    url = F.when(F.col("origin_provider") != "FURNITURE", F.concat(F.lit("https://place.example.com/"), F.col("cafe_id").cast("string"), F.lit("?ref=x")))
    return c.select("cafe_id", F.regexp_extract(url, r"^https://place[.]example[.]com/([0-9]+)", 1).alias("provider_id"))


@query()
def line_segments(spark, sf_dir):
    a, b = F.col("l_partkey") % 40, F.col("l_suppkey") % 40
    return load(spark, sf_dir, "lineitem").where(a != b).select(*audit.undirected(a, b)).distinct()


@query()
def permit_profile(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("records"), F.count_distinct("o_custkey").alias("identities"), F.min("o_orderdate").alias("first_update"), F.max("o_orderdate").alias("last_update"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query()
def strata_grouping_sets(spark, sf_dir):
    s = load(spark, sf_dir, "snapshots").select((F.col("hotspot_id") % 4).cast("int").alias("part"), F.col("observed_at").cast("date").alias("day"), "level")
    return s.cube("part", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("level").alias("levels"))


@query()
def win_rate(spark, sf_dir):
    s = load(spark, sf_dir, "snapshots")
    how = audit.outcome(F.abs(F.col("ppltn_min") - 5000), F.abs(F.col("ppltn_max") - 5250))
    return audit.count_flags(s, {"ties": how == "tie", "wins": how == "win", "losses": how == "loss"}, total=None)


@query()
def missing_hotspots(spark, sf_dir):
    """Polled hotspots without an observation in six hours."""
    h, s = tables(spark, sf_dir, "hotspots", "snapshots")
    return audit.orphans(h.where("is_polled").select("hotspot_id"), s.where(F.col("observed_at") > now() - F.expr("INTERVAL 6 HOUR")), "hotspot_id")

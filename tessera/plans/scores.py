"""Scores, freshness and read queries over points and observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.geo import haversine_m, tile_x, tile_y
from tessera.functions.timing import freshness, whole_age
from tessera.operators import materialize, scoring, spatial, temporal
from tessera.operators import search as reads
from tessera.plans.registry import query
from tessera.sources.adapters import AS_OF, load



def now():
    """The moment that the queries look from."""
    return F.expr(AS_OF)

HAVERSINE = """2 * 6371008.8 * asin(sqrt(least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE),
  pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2)))))"""
PAIR = HAVERSINE.format(a="c", b="l")
LATEST = """latest AS (SELECT * FROM (SELECT s.*, h.lat, h.lng, row_number() OVER (PARTITION BY s.hotspot_id ORDER BY s.observed_at DESC, s.event_id DESC) AS rn
  FROM snapshots s JOIN hotspots h ON h.hotspot_id = s.hotspot_id WHERE h.is_polled) x WHERE rn = 1)"""
NEAR = f"""{LATEST},
pairs AS (SELECT c.cafe_id, l.hotspot_id, l.level, l.observed_at, {PAIR} AS d FROM cafes c CROSS JOIN latest l),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cafe_id ORDER BY d, hotspot_id) AS rank FROM pairs WHERE d <= 1500) x WHERE rank <= 3)"""
AGE = f"(epoch_us({AS_OF}) - epoch_us({{c}})) / CAST(60000000 AS DOUBLE)"
SCORES = f"""{NEAR},
made AS (SELECT cafe_id, sum(level / pow(greatest(d, 50), 2)) / sum(1 / pow(greatest(d, 50), 2)) AS score, CAST(count(*) AS INT) AS neighbours,
  max(observed_at) AS newest, min(d) AS primary_distance_m, max(CASE WHEN rank = 1 THEN hotspot_id END) AS primary_hotspot_id, max(CASE WHEN rank = 1 THEN observed_at END) AS source_observed_at FROM near GROUP BY cafe_id),
conf AS (SELECT *, greatest(0, least(1, 1 - primary_distance_m / 1500)) * exp(-greatest(0, {AGE.format(c='newest')}) / 15) * least(1, neighbours / CAST(2 AS DOUBLE)) AS confidence FROM made),
scores AS (SELECT c.cafe_id, m.score, CAST(greatest(1, least(4, floor(m.score + 0.5))) AS INT) AS level,
  CASE WHEN primary_distance_m IS NULL THEN 'uncovered' WHEN primary_distance_m <= 600 THEN 'covered' ELSE 'fringe' END AS coverage,
  coalesce(m.neighbours, 0) AS neighbours, m.confidence, CASE WHEN confidence >= 0.55 THEN 'high' WHEN confidence >= 0.3 THEN 'medium' WHEN confidence IS NOT NULL THEN 'low' END AS tier,
  m.primary_hotspot_id, m.primary_distance_m, m.source_observed_at FROM cafes c LEFT JOIN conf m ON m.cafe_id = c.cafe_id)"""
SHOWN = "cafe_id, round(score, 6) AS score, CASE WHEN score IS NULL THEN NULL ELSE level END AS level, coverage, neighbours, round(confidence, 6) AS confidence, tier, primary_hotspot_id, round(primary_distance_m, 3) AS primary_distance_m, source_observed_at"


def observations(spark, sf_dir):
    return scoring.latest_polled(load(spark, sf_dir, "snapshots"), load(spark, sf_dir, "hotspots"))


def scores(spark, sf_dir):
    return scoring.score_points(load(spark, sf_dir, "cafes"), observations(spark, sf_dir), now())


def shown(df):
    return df.withColumns({"score": F.round("score", 6), "confidence": F.round("confidence", 6), "primary_distance_m": F.round("primary_distance_m", 3)})


@query(f"WITH {SCORES} SELECT {SHOWN} FROM scores")
def score_points(spark, sf_dir):
    return shown(scores(spark, sf_dir))


@query(f"WITH {LATEST} SELECT hotspot_id, event_id, observed_at, fetched_at, level FROM latest")
def latest_snapshot(spark, sf_dir):
    return observations(spark, sf_dir).select("hotspot_id", "event_id", "observed_at", "fetched_at", "level")


@query(f"WITH {LATEST}, p AS (SELECT c.cafe_id, l.hotspot_id, {PAIR} AS d FROM cafes c CROSS JOIN latest l) SELECT cafe_id, hotspot_id, round(d, 3) AS distance_m FROM p WHERE d <= 1500")
def knn_radius(spark, sf_dir):
    pairs = spatial.radius_pairs(load(spark, sf_dir, "cafes"), observations(spark, sf_dir), 1500.0)
    return pairs.select("cafe_id", "hotspot_id", F.round("distance_m", 3).alias("distance_m"))


@query(f"WITH {NEAR} SELECT cafe_id, hotspot_id, CAST(rank AS INT) AS rank FROM near")
def knn_topk(spark, sf_dir):
    cafes = load(spark, sf_dir, "cafes").select("cafe_id", "lat", "lng")
    near = spatial.nearest_at(cafes, observations(spark, sf_dir), "hotspot_id", 1500.0, 3)
    return cafes.join(near, ["lat", "lng"]).select("cafe_id", "hotspot_id", "rank")


FRESH = f"""CASE WHEN {{c}} IS NULL THEN 'n/a' WHEN {AGE} < -2 THEN 'stale' WHEN {AGE} <= 25 THEN 'fresh' WHEN {AGE} <= 120 THEN 'delayed' ELSE 'stale' END"""


@query(f"WITH {LATEST} SELECT h.hotspot_id, h.name, l.level, l.observed_at, {FRESH.format(c='l.observed_at')} AS freshness FROM hotspots h LEFT JOIN latest l ON l.hotspot_id = h.hotspot_id")
def hotspot_status(spark, sf_dir):
    found = observations(spark, sf_dir).select("hotspot_id", "level", "observed_at")
    return load(spark, sf_dir, "hotspots").select("hotspot_id", "name").join(found, "hotspot_id", "left").withColumn("freshness", freshness(F.col("observed_at"), now()))


@query(f"SELECT event_id, {FRESH.format(c='observed_at')} AS freshness FROM snapshots")
def freshness_class(spark, sf_dir):
    return load(spark, sf_dir, "snapshots").select("event_id", freshness(F.col("observed_at"), now()).alias("freshness"))


@query(f"SELECT event_id, CASE WHEN {AGE.format(c='observed_at')} >= -2 THEN CAST(greatest(0, ceil({AGE.format(c='observed_at')})) AS INT) END AS age_min FROM snapshots")
def observation_age(spark, sf_dir):
    return load(spark, sf_dir, "snapshots").select("event_id", whole_age(F.col("observed_at"), now()).alias("age_min"))


MASKED = f"""masked AS (SELECT s.*, {FRESH.format(c='source_observed_at')} AS freshness FROM scores s)"""
MASKED_SHOWN = "cafe_id, freshness, CASE WHEN score IS NOT NULL AND freshness IN ('fresh', 'delayed') THEN level END AS level, CASE WHEN freshness = 'fresh' THEN round(confidence, 6) END AS confidence"


def masked(df):
    f = freshness(F.col("source_observed_at"), now())
    return df.withColumn("freshness", f).select("cafe_id", "freshness", F.when(F.col("freshness").isin("fresh", "delayed"), F.col("level")).alias("level"), F.when(F.col("freshness") == "fresh", F.round("confidence", 6)).alias("confidence"))


@query(f"WITH {SCORES}, {MASKED} SELECT {MASKED_SHOWN} FROM masked")
def masked_serving(spark, sf_dir):
    return masked(scores(spark, sf_dir))


@query(f"WITH {SCORES}, {MASKED} SELECT {MASKED_SHOWN} FROM masked WHERE freshness = 'fresh' AND confidence >= 0.1")
def bbox_min_conf(spark, sf_dir):
    return masked(scores(spark, sf_dir)).where("confidence >= 0.1")


@query(f"WITH {SCORES} SELECT coverage, count(*) AS n FROM scores GROUP BY coverage")
def coverage_counts(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("coverage").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SCORES} SELECT cafe_id, CASE WHEN primary_distance_m <= 300 THEN 'near' WHEN primary_distance_m <= 600 THEN 'mid' WHEN primary_distance_m <= 1500 THEN 'fringe' END AS band FROM scores")
def distance_band(spark, sf_dir):
    d = F.col("primary_distance_m")
    return scores(spark, sf_dir).select("cafe_id", F.when(d <= 300, "near").when(d <= 600, "mid").when(d <= 1500, "fringe").alias("band"))


@query(f"""WITH {SCORES}, banded AS (SELECT s.cafe_id, s.primary_hotspot_id AS hotspot_id, CASE WHEN primary_distance_m <= 300 THEN 'near' WHEN primary_distance_m <= 600 THEN 'mid' ELSE 'fringe' END AS band, primary_distance_m, c.source_confidence
  FROM scores s JOIN cafes c ON c.cafe_id = s.cafe_id WHERE primary_distance_m IS NOT NULL)
SELECT hotspot_id, band, CAST(rn AS INT) AS place, cafe_id FROM (SELECT *, row_number() OVER (PARTITION BY hotspot_id, band ORDER BY source_confidence DESC, primary_distance_m, cafe_id) AS rn FROM banded) x WHERE rn <= 2""")
def band_topn(spark, sf_dir):
    from pyspark.sql import Window

    d = F.col("primary_distance_m")
    rows = scores(spark, sf_dir).where(d.isNotNull()).join(load(spark, sf_dir, "cafes").select("cafe_id", "source_confidence"), "cafe_id")
    rows = rows.select("cafe_id", F.col("primary_hotspot_id").alias("hotspot_id"), F.when(d <= 300, "near").when(d <= 600, "mid").otherwise("fringe").alias("band"), "primary_distance_m", "source_confidence")
    order = Window.partitionBy("hotspot_id", "band").orderBy(F.desc("source_confidence"), "primary_distance_m", "cafe_id")
    return rows.withColumn("place", F.row_number().over(order)).where("place <= 2").select("hotspot_id", "band", "place", "cafe_id")


BOX = "lat BETWEEN 37.50 AND 37.60 AND lng BETWEEN 126.90 AND 127.00 AND active"


@query(f"WITH boxed AS (SELECT cafe_id, name, lat, lng FROM cafes WHERE {BOX}) SELECT * FROM boxed WHERE (SELECT count(*) FROM boxed) <= 5000")
def bbox_cafes(spark, sf_dir, cap: int = 5000):
    """Active cafes inside a box, or none at all if there are more than the cap."""
    boxed = load(spark, sf_dir, "cafes").where(BOX).select("cafe_id", "name", "lat", "lng")
    n = boxed.select("cafe_id").limit(cap + 1).agg(F.count(F.lit(1)).alias("_n"))
    return boxed.crossJoin(F.broadcast(n)).where(F.col("_n") <= cap).drop("_n")


@query(f"WITH {SCORES} SELECT c.cafe_id, c.lat, c.lng, s.coverage, CASE WHEN s.score IS NOT NULL THEN s.level END AS level FROM cafes c JOIN scores s ON s.cafe_id = c.cafe_id WHERE c.active")
def cafe_summary(spark, sf_dir):
    return load(spark, sf_dir, "cafes").where("active").select("cafe_id", "lat", "lng").join(scores(spark, sf_dir).select("cafe_id", "coverage", "level"), "cafe_id")


@query(f"WITH {SCORES} SELECT c.cafe_id, c.name, s.coverage, round(s.score, 6) AS score, h.name AS hotspot_name FROM cafes c LEFT JOIN scores s ON s.cafe_id = c.cafe_id LEFT JOIN hotspots h ON h.hotspot_id = s.primary_hotspot_id")
def cafe_detail(spark, sf_dir):
    names = load(spark, sf_dir, "hotspots").select(F.col("hotspot_id").alias("primary_hotspot_id"), F.col("name").alias("hotspot_name"))
    rows = load(spark, sf_dir, "cafes").select("cafe_id", "name").join(scores(spark, sf_dir), "cafe_id", "left").join(names, "primary_hotspot_id", "left")
    return rows.select("cafe_id", "name", "coverage", F.round("score", 6).alias("score"), "hotspot_name")


@query(f"""WITH {LATEST} SELECT l.hotspot_id, s.observed_at, s.level FROM latest l JOIN snapshots s ON s.hotspot_id = l.hotspot_id
  WHERE s.observed_at > l.observed_at - INTERVAL 12 HOUR AND s.observed_at <= l.observed_at""")
def trend_12h(spark, sf_dir):
    """Observations of the 12 hours up to each hotspot's latest."""
    last = observations(spark, sf_dir).select("hotspot_id", F.col("observed_at").alias("_last"))
    rows = load(spark, sf_dir, "snapshots").select("hotspot_id", "observed_at", "level").join(last, "hotspot_id")
    return rows.where("observed_at > _last - INTERVAL 12 HOURS AND observed_at <= _last").drop("_last")


REGION = "active AND lng BETWEEN 126.76 AND 127.20 AND lat BETWEEN 37.41 AND 37.72"


@query(f"SELECT cafe_id, name FROM cafes WHERE {REGION} AND contains(lower(name), '0012') ORDER BY lower(name), cafe_id LIMIT 50")
def search_text(spark, sf_dir, q: str = " 0012 ", limit: int = 50):
    return reads.search(load(spark, sf_dir, "cafes"), q, limit=limit).select("cafe_id", "name")


@query(f"""SELECT cafe_id, name, CASE WHEN lower(name) = 'customer#00000001' THEN 0 WHEN starts_with(lower(name), 'customer#00000001') THEN 1 WHEN contains(lower(name), 'customer#00000001') THEN 2 ELSE 3 END AS relevance
FROM cafes WHERE {REGION} AND contains(lower(name), 'customer#00000001') ORDER BY relevance, lower(name), cafe_id LIMIT 20""")
def search_rank(spark, sf_dir, q: str = "Customer#00000001"):
    return reads.search(load(spark, sf_dir, "cafes"), q).select("cafe_id", "name", "relevance")


@query(f"""SELECT cafe_id, round((lat - 37.56) * (lat - 37.56) + pow((lng - 126.97) * cos(radians(37.565)), 2), 12) AS squared FROM cafes
WHERE {REGION} AND contains(lower(name), 'customer') ORDER BY (lat - 37.56) * (lat - 37.56) + pow((lng - 126.97) * cos(radians(37.565)), 2), cafe_id LIMIT 20""")
def search_near(spark, sf_dir, lat: float = 37.56, lng: float = 126.97):
    found = reads.search(load(spark, sf_dir, "cafes"), "customer", origin=(lat, lng))
    return found.select("cafe_id", F.round(reads.squared_degrees(F.col("lat"), F.col("lng"), (lat, lng)), 12).alias("squared"))


BRANDS = {"first": ["#00000002", "#00000003"], "second": ["#00000004"]}


@query(f"""SELECT cafe_id, name FROM cafes WHERE {REGION} AND (contains(lower(name), '#00000002') OR contains(lower(name), '#00000003'))
ORDER BY CASE WHEN starts_with(lower(name), 'first') THEN 1 WHEN contains(lower(name), 'first') THEN 2 ELSE 3 END, lower(name), cafe_id LIMIT 20""")
def search_brand(spark, sf_dir, brand: str = "First"):
    return reads.search(load(spark, sf_dir, "cafes"), brand=brand, aliases=BRANDS).select("cafe_id", "name")


@query("SELECT cafe_id, name FROM cafes WHERE cafe_id > 100 ORDER BY cafe_id LIMIT 50")
def keyset_page(spark, sf_dir, after: int = 100, limit: int = 50):
    return reads.page(load(spark, sf_dir, "cafes").select("cafe_id", "name"), "cafe_id", after, limit)


@query("SELECT cafe_id, round(12742000 * asin(sqrt(pow(sin(radians(lat - 37.5) / 2), 2) + cos(radians(37.5)) * cos(radians(lat)) * pow(sin(radians(lng - 127) / 2), 2))), 3) AS distance_m FROM cafes")
def by_distance(spark, sf_dir):
    return reads.by_distance(load(spark, sf_dir, "cafes"), (37.5, 127.0), "cafe_id").select("cafe_id", F.round("distance_m", 3).alias("distance_m"))


@query("SELECT cafe_id, name FROM cafes WHERE lat BETWEEN 37.5 AND 37.6 AND lng BETWEEN 126.9 AND 127.1")
def tile_merge(spark, sf_dir):
    """The cafes of a viewport, out of two tiles that overlap."""
    cafes = load(spark, sf_dir, "cafes").select("cafe_id", "name", "lat", "lng")
    return reads.merge_tiles([cafes.where("lng < 127.0"), cafes.where("lng > 126.95")], "cafe_id", (126.9, 37.5, 127.1, 37.6)).select("cafe_id", "name")


@query(f"""SELECT (SELECT count(*) FROM hotspots) AS hotspots, (SELECT count(*) FROM hotspots WHERE is_polled) AS polled, (SELECT count(*) FROM snapshots) AS snapshots,
  (SELECT count(*) FROM cafes WHERE active) AS active_cafes, (SELECT max(observed_at) FROM snapshots) AS newest, (SELECT max(started_at) FROM cycles) AS last_cycle,
  (SELECT CAST(sum(failed) AS BIGINT) FROM cycles) AS failed, (SELECT count(DISTINCT hotspot_id) FROM snapshots WHERE observed_at > {AS_OF} - INTERVAL 24 HOUR) AS seen""")
def health_stats(spark, sf_dir):
    return reads.health(*(load(spark, sf_dir, t) for t in ("hotspots", "snapshots", "cafes", "cycles")), now())


@query(f"""WITH {SCORES},
w AS (SELECT cafe_id, rank, hotspot_id, level, 1 / pow(greatest(d, 50), 2) / sum(1 / pow(greatest(d, 50), 2)) OVER (PARTITION BY cafe_id) AS weight FROM near),
c AS (SELECT cafe_id, string_agg(concat(hotspot_id, ':', level, ':', CAST(round(weight * 10000) AS BIGINT)), ',' ORDER BY rank) AS contributors FROM w GROUP BY cafe_id)
SELECT s.cafe_id, CASE WHEN s.score IS NOT NULL THEN s.level END AS level, s.coverage, s.primary_hotspot_id, s.source_observed_at, c.contributors
FROM scores s JOIN cafes k ON k.cafe_id = s.cafe_id AND k.active LEFT JOIN c ON c.cafe_id = s.cafe_id""")
def materialize_scores(spark, sf_dir):
    """Scores of active cafes with what contributed, weights in ten-thousandths."""
    made = materialize.materialize_scores(*(load(spark, sf_dir, t) for t in ("cafes", "hotspots", "snapshots")), now())
    text = F.array_join(F.transform("contributors", lambda x: F.concat_ws(":", x.hotspot_id, x.level, F.round(x.weight * 10000).cast("long"))), ",")
    return made.select("cafe_id", "level", "coverage", "primary_hotspot_id", "source_observed_at", text.alias("contributors"))


@query(f"""WITH r AS (SELECT s.* FROM snapshots s JOIN hotspots h ON h.hotspot_id = s.hotspot_id WHERE h.is_polled AND s.observed_at >= {AS_OF} - INTERVAL 12 HOUR),
l AS (SELECT *, row_number() OVER (PARTITION BY hotspot_id ORDER BY observed_at DESC, event_id DESC) AS rn FROM r),
t AS (SELECT hotspot_id, string_agg(CAST(level AS VARCHAR), ',' ORDER BY observed_at, event_id) AS trend FROM r GROUP BY hotspot_id)
SELECT t.hotspot_id, l.observed_at, t.trend, l.ppltn_min + 70 AS forecast_pop FROM t JOIN l ON l.hotspot_id = t.hotspot_id AND l.rn = 1""")
def serving_states(spark, sf_dir):
    """Trend and forecast of polled hotspots; of forecasts 70 and 50 minutes ahead, the first is taken."""
    ahead = lambda m: F.struct(F.expr(f"observed_at + INTERVAL {m} MINUTE").alias("at"), (F.col("ppltn_min") + m).alias("pop"))
    snapshots = load(spark, sf_dir, "snapshots").withColumn("forecast", F.array(ahead(120), ahead(70), ahead(50)))
    made = materialize.serving_states(load(spark, sf_dir, "hotspots"), snapshots, now())
    return made.select("hotspot_id", "observed_at", F.array_join(F.transform("trend", lambda x: x.level.cast("string")), ",").alias("trend"), F.col("forecast_1h.pop").alias("forecast_pop"))


@query("""SELECT cafe_id, CAST(floor((lng + 180) / 360 * 32768) AS INT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 32768) AS INT) AS y FROM cafes""")
def tile_cover(spark, sf_dir):
    return load(spark, sf_dir, "cafes").select("cafe_id", tile_x(F.col("lng"), 15).alias("x"), tile_y(F.col("lat"), 15).alias("y"))


@query(f"""WITH asked AS (SELECT DISTINCT hotspot_id, t FROM (SELECT o_custkey % (SELECT count(*) FROM supplier) AS hotspot_id, e.ts AS t FROM orders JOIN events e ON e.event_id = o_orderkey WHERE o_orderkey % 50 = 0) z),
ok AS (SELECT a.hotspot_id, a.t, s.event_id, s.level, row_number() OVER (PARTITION BY a.hotspot_id, a.t ORDER BY s.observed_at DESC, s.event_id DESC) AS rn
  FROM asked a JOIN snapshots s ON s.hotspot_id = a.hotspot_id AND s.observed_at <= a.t AND s.fetched_at <= a.t)
SELECT a.hotspot_id, a.t, o.event_id, o.level FROM asked a LEFT JOIN ok o ON o.hotspot_id = a.hotspot_id AND o.t = a.t AND o.rn = 1""")
def asof_snapshot(spark, sf_dir):
    from tessera.sources.adapters import run_sql

    asked = run_sql(spark, sf_dir, "SELECT o_custkey % (SELECT count(*) FROM supplier) AS hotspot_id, e.ts AS t FROM orders JOIN events e ON e.event_id = o_orderkey WHERE o_orderkey % 50 = 0")
    return temporal.as_of(asked, load(spark, sf_dir, "snapshots"), "hotspot_id", "t", "observed_at", "fetched_at", "event_id").select("hotspot_id", "t", "event_id", "level")


HORIZON = """h AS (SELECT unnest([10, 30, 60, 90, 120]) AS horizon),
s AS (SELECT hotspot_id, event_id, observed_at, level, (ppltn_min + ppltn_max) / CAST(2 AS DOUBLE) AS pop FROM snapshots),
m AS (SELECT s.hotspot_id, s.event_id, h.horizon, s.level, s.pop, a.level AS a_level, a.pop AS a_pop, row_number() OVER (PARTITION BY s.event_id, h.horizon ORDER BY abs(epoch_us(a.observed_at) - epoch_us(s.observed_at) - h.horizon * CAST(60000000 AS BIGINT)), a.observed_at) AS rn
  FROM s CROSS JOIN h JOIN s a ON a.hotspot_id = s.hotspot_id AND abs(epoch_us(a.observed_at) - epoch_us(s.observed_at) - h.horizon * CAST(60000000 AS BIGINT)) <= 150000000)"""


def delay_pairs(spark, sf_dir):
    from tessera.params import SourceDelay

    p = SourceDelay()
    s = load(spark, sf_dir, "snapshots").select("hotspot_id", "event_id", "observed_at", "level", ((F.col("ppltn_min") + F.col("ppltn_max")) / 2.0).alias("pop"))
    asked = s.withColumn("horizon", F.explode(F.array(*map(F.lit, p.horizons_min))))
    asked = asked.withColumn("target", F.expr("observed_at + make_dt_interval(0, 0, horizon, 0)")).withColumn("_id", F.struct("event_id", "horizon")).drop("observed_at")
    actual = s.select("hotspot_id", "observed_at", F.col("level").alias("a_level"), F.col("pop").alias("a_pop"))
    return temporal.nearest_in_time(asked, actual, "hotspot_id", "target", "observed_at", p.tolerance_min)


@query(f"WITH {HORIZON} SELECT event_id, CAST(horizon AS INT) AS horizon, a_level AS actual_level FROM m WHERE rn = 1")
def nearest_actual(spark, sf_dir):
    return delay_pairs(spark, sf_dir).select("event_id", "horizon", F.col("a_level").alias("actual_level"))


METRICS = "count(*) AS n, round(avg(abs(a_pop - pop)), 6) AS mae, round(CASE WHEN sum(a_pop) > 0 THEN sum(abs(a_pop - pop)) / sum(a_pop) END, 9) AS wape, round(avg(pop - a_pop), 6) AS bias, round(avg(CASE WHEN level = a_level THEN 1.0 ELSE 0.0 END), 9) AS exact_share, round(avg(CASE WHEN abs(level - a_level) <= 1 THEN 1.0 ELSE 0.0 END), 9) AS adjacent_share"


@query(f"WITH {HORIZON} SELECT CAST(horizon AS INT) AS horizon, {METRICS.replace('1.0', 'CAST(1 AS DOUBLE)').replace('0.0', 'CAST(0 AS DOUBLE)')} FROM m WHERE rn = 1 GROUP BY horizon")
def forecast_metrics(spark, sf_dir):
    """Persistence judged at each horizon."""
    gap = F.col("pop") - F.col("a_pop")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 9)
    return delay_pairs(spark, sf_dir).groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.abs(gap)), 6).alias("mae"),
        F.round(F.when(F.sum("a_pop") > 0, F.sum(F.abs(gap)) / F.sum("a_pop")), 9).alias("wape"),
        F.round(F.avg(gap), 6).alias("bias"),
        share(F.col("level") == F.col("a_level")).alias("exact_share"),
        share(F.abs(F.col("level") - F.col("a_level")) <= 1).alias("adjacent_share"),
    )


@query(f"""WITH {SCORES}, p AS (SELECT c.cafe_id, {HAVERSINE.format(a='c', b='h')} AS d, s.score FROM cafes c JOIN scores s ON s.cafe_id = c.cafe_id JOIN hotspots h ON h.hotspot_id = s.primary_hotspot_id)
SELECT cafe_id, round(d, 3) AS distance_m, round(abs(score - 2), 6) AS divergence FROM p ORDER BY abs(score - 2) DESC, cafe_id LIMIT 20""")
def divergence_topk(spark, sf_dir):
    """The 20 scores farthest from level 2, with the distance to their hotspot found anew."""
    hot = load(spark, sf_dir, "hotspots").select(F.col("hotspot_id").alias("primary_hotspot_id"), F.col("lat").alias("_a"), F.col("lng").alias("_b"))
    rows = scores(spark, sf_dir).where("score IS NOT NULL").join(load(spark, sf_dir, "cafes").select("cafe_id", "lat", "lng"), "cafe_id").join(hot, "primary_hotspot_id")
    gap = F.abs(F.col("score") - 2)
    top = rows.orderBy(gap.desc(), "cafe_id").limit(20)
    return top.select("cafe_id", F.round(haversine_m(F.col("lat"), F.col("lng"), F.col("_a"), F.col("_b")), 3).alias("distance_m"), F.round(gap, 6).alias("divergence"))


@query(f"""WITH {SCORES}, t AS (SELECT cafe_id, coverage AS before, CASE WHEN primary_distance_m <= 900 THEN 'covered' WHEN primary_distance_m IS NULL THEN 'uncovered' ELSE 'fringe' END AS after FROM scores),
k AS (SELECT unnest(['covered', 'fringe', 'uncovered']) AS c)
SELECT a.c AS before, b.c AS after, count(t.cafe_id) AS n FROM k a CROSS JOIN k b LEFT JOIN t ON t.before = a.c AND t.after = b.c GROUP BY a.c, b.c""")
def coverage_transition(spark, sf_dir):
    """How coverage changes if 900 m count as covered, with the combinations that don't occur."""
    d = F.col("primary_distance_m")
    moved = scores(spark, sf_dir).groupBy(F.col("coverage").alias("before"), F.when(d <= 900, "covered").when(d.isNull(), "uncovered").otherwise("fringe").alias("after")).agg(F.count(F.lit(1)).alias("n"))
    kinds = spark.createDataFrame([("covered",), ("fringe",), ("uncovered",)], "before string")
    grid = kinds.crossJoin(kinds.withColumnRenamed("before", "after"))
    return grid.join(F.broadcast(moved), ["before", "after"], "left").na.fill(0, ["n"])

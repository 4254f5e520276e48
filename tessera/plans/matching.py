"""Catalogues matched, compared and profiled."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import entity
from tessera.plans.registry import query, sql_of
from tessera.plans.scores import HAVERSINE
from tessera.sources.adapters import load

PAIRS = f"""raw AS (SELECT a.place_id AS a_id, b.place_id AS b_id, a.norm_name = b.norm_name AS same_name, coalesce(a.phone = b.phone, false) AS same_phone, {HAVERSINE.format(a='a', b='b')} AS d
  FROM catalogue_a a JOIN catalogue_b b ON (a.norm_name = b.norm_name OR a.phone = b.phone)),
pairs AS (SELECT a_id, b_id, same_name AND d <= 50 AS by_name, same_phone AND d <= 150 AS by_phone, d FROM raw WHERE (same_name AND d <= 50) OR (same_phone AND d <= 150)),
matched AS (SELECT a_id, b_id, d, CASE WHEN by_name AND by_phone THEN 'both' WHEN by_name THEN 'name' ELSE 'phone' END AS rule,
  CASE WHEN count(*) OVER (PARTITION BY a_id) = 1 AND count(*) OVER (PARTITION BY b_id) = 1 THEN 'verified' ELSE 'ambiguous' END AS status FROM pairs)"""


def pairs(spark, sf_dir):
    return entity.candidate_pairs(load(spark, sf_dir, "catalogue_a"), load(spark, sf_dir, "catalogue_b"))


@query(f"WITH {PAIRS} SELECT a_id, b_id, by_name, by_phone, round(d, 3) AS distance_m FROM pairs")
def reconcile_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).withColumn("distance_m", F.round("distance_m", 3))


@query(f"WITH {PAIRS} SELECT a_id, b_id, rule, status FROM matched")
def reconcile(spark, sf_dir):
    return entity.reconcile(pairs(spark, sf_dir)).select("a_id", "b_id", "rule", "status")


@query(f"WITH {PAIRS} SELECT rule, status, count(*) AS n FROM matched GROUP BY rule, status")
def category_counts(spark, sf_dir):
    return entity.reconcile(pairs(spark, sf_dir)).groupBy("rule", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH h AS (SELECT a.place_id AS a_id, b.place_id AS b_id, CAST((CASE WHEN a.norm_name = b.norm_name THEN 1 ELSE 0 END) + (CASE WHEN a.phone = b.phone THEN 1 ELSE 0 END) + (CASE WHEN a.lat = b.lat THEN 1 ELSE 0 END) AS INT) AS n_signals
  FROM catalogue_a a JOIN catalogue_b b ON (a.norm_name = b.norm_name OR a.phone = b.phone OR a.lat = b.lat)), k AS (SELECT * FROM h WHERE n_signals >= 2)
SELECT a_id, b_id, n_signals, CASE WHEN count(*) OVER (PARTITION BY a_id) > 1 OR count(*) OVER (PARTITION BY b_id) > 1 THEN 'ambiguous' ELSE 'verified' END AS status FROM k""")
def identity_two_signal(spark, sf_dir):
    return entity.two_signals(load(spark, sf_dir, "catalogue_a"), load(spark, sf_dir, "catalogue_b"), ["norm_name", "phone", "lat"])


@query(f"WITH {PAIRS} SELECT a.place_id FROM catalogue_a a WHERE a.place_id NOT IN (SELECT a_id FROM pairs)")
def unlinked_places(spark, sf_dir):
    a = load(spark, sf_dir, "catalogue_a")
    return a.join(pairs(spark, sf_dir), a.place_id == F.col("a_id"), "left_anti").select("place_id")


@query(f"""WITH p AS (SELECT a.place_id AS a_id, b.place_id AS b_id, {HAVERSINE.format(a='a', b='b')} AS d FROM catalogue_b a JOIN catalogue_b b ON a.norm_name = b.norm_name AND a.place_id < b.place_id) SELECT a_id, b_id, round(d, 3) AS distance_m FROM p WHERE d <= 100""")
def peer_conflicts(spark, sf_dir):
    from tessera.functions.geo import haversine_m

    b = load(spark, sf_dir, "catalogue_b")
    x = b.select(F.col("place_id").alias("a_id"), "norm_name", F.col("lat").alias("_a"), F.col("lng").alias("_b"))
    y = b.select(F.col("place_id").alias("b_id"), "norm_name", F.col("lat").alias("_c"), F.col("lng").alias("_d"))
    d = haversine_m(F.col("_a"), F.col("_b"), F.col("_c"), F.col("_d"))
    return x.join(y, "norm_name").where("a_id < b_id").withColumn("d", d).where("d <= 100").select("a_id", "b_id", F.round("d", 3).alias("distance_m"))


NEW = "new AS (SELECT place_id - 1000000 AS place_id, norm_name, phone, lat, lng FROM catalogue_b WHERE place_id < 2000000)"


def releases(spark, sf_dir):
    new = load(spark, sf_dir, "catalogue_b").where("place_id < 2000000").withColumn("place_id", F.col("place_id") - 1000000)
    return load(spark, sf_dir, "catalogue_a").where("place_id % 7 <> 3"), new


@query(f"""WITH {NEW}, old AS (SELECT * FROM catalogue_a WHERE place_id % 7 <> 3),
j AS (SELECT coalesce(o.place_id, n.place_id) AS place_id, o.place_id AS o_id, n.place_id AS n_id, (CASE WHEN o.norm_name IS DISTINCT FROM n.norm_name THEN 1 ELSE 0 END) + (CASE WHEN o.phone IS DISTINCT FROM n.phone THEN 1 ELSE 0 END) + (CASE WHEN NOT coalesce(abs(o.lat - n.lat) <= 1e-12, false) THEN 1 ELSE 0 END) AS c FROM old o FULL JOIN new n ON o.place_id = n.place_id)
SELECT place_id, CASE WHEN o_id IS NULL THEN 'insert' WHEN n_id IS NULL THEN 'deactivate' WHEN c > 0 THEN 'update' ELSE 'unchanged' END AS change, CAST(CASE WHEN o_id IS NULL OR n_id IS NULL THEN 0 ELSE c END AS INT) AS n_changed FROM j""")
def release_diff(spark, sf_dir):
    old, new = releases(spark, sf_dir)
    return entity.release_diff(old, new, "place_id", ["norm_name", "phone", "lat"], 1e-12, ("lat",))


@query(f"""WITH {NEW}, j AS (SELECT {HAVERSINE.format(a='o', b='n')} AS d FROM catalogue_a o JOIN new n ON o.place_id = n.place_id), b AS (SELECT CASE WHEN d <= 10 THEN 10 WHEN d <= 50 THEN 50 WHEN d <= 250 THEN 250 WHEN d <= 1000 THEN 1000 ELSE -1 END AS edge_m FROM j), e AS (SELECT unnest([10, 50, 250, 1000, -1]) AS edge_m)
SELECT e.edge_m, count(b.edge_m) AS n FROM e LEFT JOIN b ON b.edge_m = e.edge_m GROUP BY e.edge_m""")
def move_buckets(spark, sf_dir):
    """How far places moved between releases; buckets without any stay."""
    from tessera.functions.geo import haversine_m

    _, new = releases(spark, sf_dir)
    o = load(spark, sf_dir, "catalogue_a")
    d = haversine_m(o.lat, o.lng, F.col("_lat"), F.col("_lng"))
    j = o.join(new.select("place_id", F.col("lat").alias("_lat"), F.col("lng").alias("_lng")), "place_id").select(d.alias("d"))
    edge = F.when(F.col("d") <= 10, 10).when(F.col("d") <= 50, 50).when(F.col("d") <= 250, 250).when(F.col("d") <= 1000, 1000).otherwise(-1)
    counts = j.groupBy(edge.alias("edge_m")).agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(10,), (50,), (250,), (1000,), (-1,)], "edge_m int").join(F.broadcast(counts), "edge_m", "left").na.fill(0, ["n"])


@query("""WITH b AS (SELECT CAST(floor(source_confidence / CAST(0.05 AS DOUBLE) + 1e-9) AS INT) AS bucket FROM cafes), k AS (SELECT unnest(range(0, 21)) AS bucket) SELECT CAST(k.bucket AS INT) AS bucket, count(b.bucket) AS n FROM k LEFT JOIN b ON b.bucket = k.bucket GROUP BY k.bucket""")
def confidence_histogram(spark, sf_dir):
    counts = load(spark, sf_dir, "cafes").groupBy(F.floor(F.col("source_confidence") / 0.05 + 1e-9).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(21).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counts), "bucket", "left").na.fill(0, ["n"])


@query("""WITH r AS (SELECT cafe_id, origin_provider, row_number() OVER (PARTITION BY origin_provider ORDER BY sha256(CAST(cafe_id AS VARCHAR)), cafe_id) AS rn FROM cafes) SELECT cafe_id, origin_provider, CAST(rn AS INT) AS turn FROM r ORDER BY rn, origin_provider LIMIT 40""")
def hash_round_robin(spark, sf_dir):
    """40 cafes in turns over the providers, in each by the digest of its id."""
    w = Window.partitionBy("origin_provider").orderBy(F.sha2(F.col("cafe_id").cast("string").cast("binary"), 256), "cafe_id")
    return load(spark, sf_dir, "cafes").select("cafe_id", "origin_provider", F.row_number().over(w).alias("turn")).orderBy("turn", "origin_provider").limit(40)


sql_of("provider_matrix", """WITH o AS (SELECT DISTINCT origin_provider FROM cafes), b AS (SELECT 'low' AS band UNION ALL SELECT 'high'), c AS (SELECT origin_provider, CASE WHEN source_confidence >= 0.8 THEN 'high' ELSE 'low' END AS band, cafe_id FROM cafes WHERE active)
SELECT o.origin_provider, b.band, count(c.cafe_id) AS n FROM o CROSS JOIN b LEFT JOIN c ON c.origin_provider = o.origin_provider AND c.band = b.band GROUP BY o.origin_provider, b.band""")
sql_of("curated_admission", "SELECT c.cafe_id, CASE WHEN c.source_confidence >= 0.8 THEN 'confidence' ELSE 'match' END AS reason FROM cafes c LEFT JOIN (SELECT DISTINCT place_id - 1000000 AS cafe_id FROM catalogue_b WHERE phone IS NOT NULL AND place_id < 2000000) m ON m.cafe_id = c.cafe_id WHERE c.source_confidence >= 0.8 OR m.cafe_id IS NOT NULL")
sql_of("region_gate", "SELECT cafe_id, lat BETWEEN 37.41 AND 37.72 AND lng BETWEEN 126.76 AND 127.20 AND name LIKE 'Customer%' AS inside_region FROM cafes")
sql_of("exact_dups", "SELECT count(*) AS n, count(*) - count(DISTINCT concat(norm_name, '|', coalesce(phone, ''))) AS duplicates FROM catalogue_b")
sql_of("conflict_reasons", """SELECT norm_name, count(*) AS n, CASE WHEN count(DISTINCT coalesce(phone, '')) > 1 THEN 'phone' END AS phone_conflict, CASE WHEN count(DISTINCT lat) > 1 THEN 'lat' END AS lat_conflict FROM catalogue_b GROUP BY norm_name HAVING count(*) > 1""")
sql_of("latest_by_update", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) x WHERE rn = 1")
sql_of("observer_assign", "SELECT cafe_id, slot, observed_at, CASE WHEN (row_number() OVER (PARTITION BY slot ORDER BY observed_at, cafe_id)) % 2 = 1 THEN 'a' ELSE 'b' END AS observer FROM truths")
sql_of("area_nearest_rank", "SELECT origin_provider, percentile_disc(0.5) WITHIN GROUP (ORDER BY source_confidence) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY source_confidence) AS p95 FROM cafes GROUP BY origin_provider")
sql_of("decimal_profile", """SELECT count(*) AS n, CAST(sum(CASE WHEN c_acctbal = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives, CAST(sum(CASE WHEN c_acctbal > 9000 THEN 1 ELSE 0 END) AS BIGINT) AS extremes, min(c_acctbal) AS least, max(c_acctbal) AS most FROM customer""")
sql_of("constraint_violations", """SELECT 'lat' AS rule, CAST(sum(CASE WHEN lat BETWEEN -90 AND 90 THEN 0 ELSE 1 END) AS BIGINT) AS n FROM hotspots UNION ALL
SELECT 'level', CAST(sum(CASE WHEN level BETWEEN 1 AND 4 THEN 0 ELSE 1 END) AS BIGINT) FROM snapshots UNION ALL SELECT 'bounds', CAST(sum(CASE WHEN ppltn_min <= ppltn_max AND ppltn_min >= 0 THEN 0 ELSE 1 END) AS BIGINT) FROM snapshots UNION ALL
SELECT 'natural_key', count(*) FROM (SELECT hotspot_id, observed_at FROM snapshots GROUP BY hotspot_id, observed_at HAVING count(*) > 1) k UNION ALL
SELECT 'orphan', count(*) FROM snapshots s LEFT JOIN hotspots h ON h.hotspot_id = s.hotspot_id WHERE h.hotspot_id IS NULL""")

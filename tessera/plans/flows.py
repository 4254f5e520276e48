"""Origin-destination flows and grid cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import flows
from tessera.plans.registry import query, sql_of
from tessera.sources.adapters import load

NET = """a AS (SELECT destination_id AS zone_id, arrival_hour AS hour, sum(flow) AS inbound, sum(CASE WHEN origin_id = destination_id THEN flow ELSE 0 END) AS intrazonal FROM od_flows GROUP BY destination_id, arrival_hour),
b AS (SELECT origin_id AS zone_id, departure_hour AS hour, sum(flow) AS outbound FROM od_flows GROUP BY origin_id, departure_hour),
net AS (SELECT coalesce(a.zone_id, b.zone_id) AS zone_id, coalesce(a.hour, b.hour) AS hour, coalesce(inbound, 0) AS inbound, coalesce(outbound, 0) AS outbound, coalesce(intrazonal, 0) AS intrazonal, coalesce(inbound, 0) - coalesce(outbound, 0) AS net FROM a FULL JOIN b ON a.zone_id = b.zone_id AND a.hour = b.hour)"""


@query(f"WITH {NET} SELECT * FROM net WHERE inbound + outbound > 0")
def od_net_flow(spark, sf_dir):
    return flows.net_flow(load(spark, sf_dir, "od_flows"))


@query("""WITH f AS (SELECT origin_id, destination_id, arrival_hour AS hour, sum(flow) AS flow FROM od_flows WHERE origin_id <> destination_id GROUP BY 1, 2, 3),
v AS (SELECT a.zone_id AS origin_id, b.zone_id AS destination_id, sin(radians(b.lng - a.lng)) * cos(radians(b.lat)) AS e, cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lng - a.lng)) AS n FROM od_centroids a CROSS JOIN od_centroids b),
u AS (SELECT origin_id, destination_id, e / sqrt(e * e + n * n) AS e, n / sqrt(e * e + n * n) AS n FROM v WHERE sqrt(e * e + n * n) > 7.2e-15),
g AS (SELECT f.destination_id AS zone_id, hour, sum(flow) AS eligible, sum(CASE WHEN u.e IS NOT NULL THEN flow ELSE 0 END) AS known, sum(CASE WHEN u.e IS NOT NULL THEN flow * u.e ELSE 0 END) AS e, sum(CASE WHEN u.n IS NOT NULL THEN flow * u.n ELSE 0 END) AS n FROM f LEFT JOIN u ON u.origin_id = f.origin_id AND u.destination_id = f.destination_id GROUP BY f.destination_id, hour)
SELECT zone_id, hour, eligible, round(known / eligible, 9) AS coverage, round(CASE WHEN known > 0 THEN least(1, sqrt(e * e + n * n) / known) END, 9) AS strength,
  round(CASE WHEN known > 0 AND sqrt(e * e + n * n) / known > 1e-9 THEN CASE WHEN atan2(e, n) < 0 THEN degrees(atan2(e, n)) + 360 ELSE degrees(atan2(e, n)) END END, 6) AS bearing FROM g""")
def od_direction(spark, sf_dir):
    d = flows.direction(load(spark, sf_dir, "od_flows"), load(spark, sf_dir, "od_centroids"))
    return d.withColumns({"coverage": F.round("coverage", 9), "strength": F.round("strength", 9), "bearing": F.round("bearing", 6)})


@query("SELECT destination_id, purpose, sum(flow) AS flow, round(sum(flow) / sum(sum(flow)) OVER (PARTITION BY destination_id), 9) AS ratio FROM od_flows GROUP BY destination_id, purpose")
def od_purpose_ratio(spark, sf_dir):
    from pyspark.sql import Window

    g = load(spark, sf_dir, "od_flows").groupBy("destination_id", "purpose").agg(F.sum("flow").alias("flow"))
    return g.withColumn("ratio", F.round(F.col("flow") / F.sum("flow").over(Window.partitionBy("destination_id")), 9))


sql_of("od_coverage", """SELECT count(*) AS n, count(DISTINCT f.origin_id) AS origins, CAST(sum(CASE WHEN a.zone_id IS NULL OR b.zone_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS uncovered, sum(CASE WHEN f.origin_id = f.destination_id THEN f.flow ELSE 0 END) AS intrazonal
  FROM od_flows f LEFT JOIN od_centroids a ON a.zone_id = f.origin_id LEFT JOIN od_centroids b ON b.zone_id = f.destination_id""")
sql_of("od_missing_codes", "SELECT DISTINCT f.origin_id AS zone_id FROM od_flows f LEFT JOIN od_centroids a ON a.zone_id = f.origin_id WHERE a.zone_id IS NULL")
sql_of("od_centroid_join", "SELECT f.origin_id, f.destination_id, sum(f.flow) AS flow, max(a.lat) AS o_lat, max(b.lat) AS d_lat FROM od_flows f LEFT JOIN od_centroids a ON a.zone_id = f.origin_id LEFT JOIN od_centroids b ON b.zone_id = f.destination_id GROUP BY f.origin_id, f.destination_id")
sql_of("od_weighted_means", "SELECT origin_id, round(sum(flow * abs(arrival_hour - departure_hour)) / sum(flow), 6) AS mean_hours, sum(flow) AS flow FROM od_flows GROUP BY origin_id")
sql_of("key_union", "SELECT origin_id AS zone_id, departure_hour AS hour FROM od_flows UNION SELECT destination_id, arrival_hour FROM od_flows")
sql_of("complete_zones", "SELECT destination_id AS zone_id FROM od_flows WHERE arrival_hour IN (7, 8, 9) GROUP BY destination_id HAVING count(DISTINCT arrival_hour) = 3")
sql_of("set_difference", "SELECT origin_id AS zone_id FROM od_flows EXCEPT SELECT zone_id FROM od_centroids")
sql_of("code_set_diff", "SELECT coalesce(a.n_nationkey, b.zone_id) AS zone_id, CASE WHEN b.zone_id IS NULL THEN 'left' WHEN a.n_nationkey IS NULL THEN 'right' ELSE 'both' END AS side FROM nation a FULL JOIN od_centroids b ON a.n_nationkey = b.zone_id")
sql_of("paired_stock", """WITH a AS (SELECT destination_id AS zone_id, sum(flow) AS stock FROM od_flows WHERE arrival_hour = 8 AND purpose = 1 GROUP BY destination_id),
b AS (SELECT destination_id AS zone_id, sum(flow) AS stock FROM od_flows WHERE arrival_hour = 9 AND purpose = 2 GROUP BY destination_id)
SELECT coalesce(a.zone_id, b.zone_id) AS zone_id, coalesce(a.stock, 0) AS before_stock, coalesce(b.stock, 0) AS after_stock, coalesce(b.stock, 0) - coalesce(a.stock, 0) AS change FROM a FULL JOIN b ON a.zone_id = b.zone_id""")
sql_of("jaccard_decile", """WITH t AS (SELECT destination_id AS zone_id, purpose, sum(flow) AS flow FROM od_flows WHERE purpose IN (1, 2) GROUP BY destination_id, purpose),
r AS (SELECT zone_id, purpose, row_number() OVER (PARTITION BY purpose ORDER BY flow DESC, zone_id) AS rn, count(*) OVER (PARTITION BY purpose) AS k FROM t),
top AS (SELECT zone_id, purpose FROM r WHERE rn <= ceil(k * 0.2))
SELECT count(*) AS both_sets, CAST(sum(CASE WHEN n = 2 THEN 1 ELSE 0 END) AS BIGINT) AS shared_zones, round(CAST(sum(CASE WHEN n = 2 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 9) AS jaccard FROM (SELECT zone_id, count(*) AS n FROM top GROUP BY zone_id) z""")
sql_of("weekly_pairs", "SELECT a.cell_id, a.observed_date AS first_date, b.observed_date AS second_date FROM (SELECT DISTINCT cell_id, observed_date FROM cell_fragments) a JOIN (SELECT DISTINCT cell_id, observed_date FROM cell_fragments) b ON a.cell_id = b.cell_id AND b.observed_date = date_add(a.observed_date, 7)".replace("date_add(a.observed_date, 7)", "a.observed_date + INTERVAL 7 DAY"))

sql_of("validation_counts", """SELECT count(*) AS n, CAST(sum(CASE WHEN masked THEN 1 ELSE 0 END) AS BIGINT) AS masked_rows, CAST(sum(CASE WHEN known_value < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative,
  CAST(sum(CASE WHEN masked AND known_value IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS masked_known, CAST(sum(CASE WHEN hour NOT BETWEEN 0 AND 23 THEN 1 ELSE 0 END) AS BIGINT) AS bad_hour FROM cell_fragments""")
sql_of("dup_fragments", "SELECT cell_id, observed_date, hour, count(*) AS n FROM cell_fragments GROUP BY cell_id, observed_date, hour HAVING count(*) > 1 ORDER BY cell_id, observed_date, hour LIMIT 1")
sql_of("mask_summary", """WITH g AS (SELECT cell_id, observed_date, hour, count(*) AS n, sum(CASE WHEN masked THEN 1 ELSE 0 END) AS m FROM cell_fragments GROUP BY cell_id, observed_date, hour)
SELECT count(*) AS cell_hours, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS multi, CAST(sum(CASE WHEN m > 0 AND m < n THEN 1 ELSE 0 END) AS BIGINT) AS partial_masked, CAST(sum(CASE WHEN m = n THEN 1 ELSE 0 END) AS BIGINT) AS all_masked, max(n) AS most FROM g""")
sql_of("missing_cells", "SELECT a.cell_id FROM (SELECT CAST(n_nationkey AS INT) AS cell_id FROM nation) a LEFT JOIN (SELECT DISTINCT cell_id FROM cell_fragments) f ON f.cell_id = a.cell_id WHERE f.cell_id IS NULL")
sql_of("allowlist_semi", "SELECT cell_id, count(*) AS n FROM cell_fragments WHERE cell_id IN (SELECT CAST(r_regionkey AS INT) FROM region WHERE r_regionkey < 3) GROUP BY cell_id")
sql_of("owner_conflict", "SELECT known_value, count(DISTINCT cell_id) AS owners FROM cell_fragments WHERE known_value IS NOT NULL GROUP BY known_value HAVING count(DISTINCT cell_id) > 1")


@query("""SELECT cell_id, observed_date, hour, sum(known_value) AS known_total, count(*) AS fragment_count, CAST(sum(CASE WHEN masked THEN 1 ELSE 0 END) AS BIGINT) AS masked_fragment_count,
  string_agg(CAST(fragment_id AS VARCHAR) || CASE WHEN masked THEN '*' ELSE '' END, ',' ORDER BY fragment_id) AS fragments FROM cell_fragments GROUP BY cell_id, observed_date, hour""")
def compact_cells(spark, sf_dir):
    """One row for each cell and hour: the exact known total and its fragments in order."""
    item = F.struct("fragment_id", F.concat(F.col("fragment_id").cast("string"), F.when(F.col("masked"), "*").otherwise("")).alias("s"))
    return load(spark, sf_dir, "cell_fragments").groupBy("cell_id", "observed_date", "hour").agg(
        F.sum("known_value").cast("decimal(38,5)").alias("known_total"),
        F.count(F.lit(1)).alias("fragment_count"),
        F.count_if("masked").alias("masked_fragment_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.s), ",").alias("fragments"),
    )


CUTOFF, WEEKDAY = "1995-07-01", 3
STATS = ", ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS n_{k}, sum(CASE WHEN {c} THEN w ELSE 0 END) AS w_{k}, sum(CASE WHEN {c} THEN w * w ELSE 0 END) AS ww_{k}, sum(CASE WHEN {c} THEN w * x ELSE 0 END) AS x_{k}, sum(CASE WHEN {c} THEN w * x * x ELSE 0 END) AS xx_{k}" for k, c in (("e", f"wd = {WEEKDAY}"), ("t", "wd < 6"), ("h", "true")))
MEANS = ", ".join(f"x_{k} / nullif(w_{k}, 0) AS m_{k}, greatest(0, xx_{k} / nullif(w_{k}, 0) - pow(x_{k} / nullif(w_{k}, 0), 2)) AS v_{k}, w_{k} * w_{k} / nullif(ww_{k}, 0) AS f_{k}" for k in "eth")
BASELINE = f"""r AS (SELECT cell_id, hour, isodow(observed_date) AS wd, exp(-ln(2) * date_diff('day', observed_date, DATE '{CUTOFF}') / 28) AS w, ln(1 + CASE WHEN masked THEN 2 ELSE CAST(known_value AS DOUBLE) END) AS x
  FROM cell_fragments WHERE date_diff('day', observed_date, DATE '{CUTOFF}') BETWEEN 1 AND 84),
g AS (SELECT cell_id, hour, {STATS} FROM r GROUP BY cell_id, hour), m AS (SELECT *, {MEANS} FROM g),
p AS (SELECT *, CASE WHEN n_e >= 3 THEN 'exact' WHEN n_t >= 3 THEN 'type' ELSE 'hour' END AS bucket, f_e / (f_e + 4) AS ae, f_t / (f_t + 4) AS aty FROM m),
base AS (SELECT cell_id, hour, bucket, CASE bucket WHEN 'exact' THEN n_e WHEN 'type' THEN n_t ELSE n_h END AS raw_n, CASE bucket WHEN 'exact' THEN f_e WHEN 'type' THEN f_t ELSE f_h END AS effective_n,
  CASE bucket WHEN 'exact' THEN ae * m_e + (1 - ae) * m_t WHEN 'type' THEN aty * m_t + (1 - aty) * m_h ELSE m_h END AS mean,
  CASE bucket WHEN 'exact' THEN ae * v_e + (1 - ae) * v_t + ae * (1 - ae) * pow(m_e - m_t, 2) WHEN 'type' THEN aty * v_t + (1 - aty) * v_h + aty * (1 - aty) * pow(m_t - m_h, 2) ELSE v_h END AS var FROM p)"""


def baselines(spark, sf_dir):
    from tessera.operators.baseline import temporal_baseline

    rows = load(spark, sf_dir, "cell_fragments").withColumn("value", F.col("known_value").cast("double"))
    return temporal_baseline(rows, CUTOFF, WEEKDAY)


@query(f"WITH {BASELINE} SELECT cell_id, hour, bucket, CAST(raw_n AS BIGINT) AS raw_n, round(effective_n, 6) AS effective_n, round(exp(mean) - 1, 4) AS expected, round(sqrt(var), 6) AS dispersion FROM base")
def temporal_baseline(spark, sf_dir):
    return baselines(spark, sf_dir).drop("masked_share", "fallback_depth").withColumns({"effective_n": F.round("effective_n", 6), "expected": F.round("expected", 4), "dispersion": F.round("dispersion", 6)})


@query(f"""WITH {BASELINE}, day AS (SELECT cell_id, hour, fragment_id, CAST(known_value AS DOUBLE) AS v FROM cell_fragments WHERE observed_date = DATE '{CUTOFF}' AND known_value IS NOT NULL)
SELECT d.fragment_id, round(greatest(-5, least(5, CASE WHEN sqrt(var) >= 1e-6 THEN (ln(1 + v) - mean) / sqrt(var) ELSE ln(1 + v) - mean END)), 6) AS anomaly FROM day d JOIN base b ON b.cell_id = d.cell_id AND b.hour = d.hour""")
def activity_anomaly(spark, sf_dir):
    from tessera.operators.baseline import anomaly

    day = load(spark, sf_dir, "cell_fragments").where(f"observed_date = DATE '{CUTOFF}' AND known_value IS NOT NULL")
    rows = day.join(baselines(spark, sf_dir), ["cell_id", "hour"])
    return rows.select("fragment_id", F.round(anomaly(F.col("known_value").cast("double"), F.col("expected"), F.col("dispersion")), 6).alias("anomaly"))


@query("WITH d AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(o_totalprice AS DOUBLE) AS demand, CAST(o_custkey % 200 AS DOUBLE) AS area FROM orders) SELECT id, round(demand * pow(42.9 / greatest(area, 10), CAST(0.5 AS DOUBLE)), 4) AS pressure FROM d")
def capacity_pressure(spark, sf_dir):
    from tessera.operators.scoring import capacity_pressure as pressure

    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(F.col("o_orderkey").cast("long").alias("id"), F.round(pressure(F.col("o_totalprice").cast("double"), (F.col("o_custkey") % 200).cast("double")), 4).alias("pressure"))

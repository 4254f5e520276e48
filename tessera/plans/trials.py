"""Trials of models and sources, over the score's points and over dated flows and stocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import params
from tessera.operators import trials
from tessera.plans.evidence import points_then
from tessera.plans.registry import query, stored
from tessera.sources.adapters import load

# Fixed value: the days of the trials and their roles
ROLES = (("2024-01-02", "held_out"), ("2024-01-09", "held_out"), ("2024-01-16", "held_out"), ("2024-01-23", "discovery"), ("2024-01-27", "descriptive_only"))


def rank_sql(group: str, value: str) -> str:
    return f"rank() OVER (PARTITION BY {group} ORDER BY {value}) + (count(*) OVER (PARTITION BY {group}, {value}) - 1) / CAST(2 AS DOUBLE)"


def rho_sql(x: str, y: str) -> str:
    spread = f"(count(*) * sum({x} * {x}) - sum({x}) * sum({x})) * (count(*) * sum({y} * {y}) - sum({y}) * sum({y}))"
    return f"round(CASE WHEN {spread} > 0 THEN (count(*) * sum({x} * {y}) - sum({x}) * sum({y})) / sqrt({spread}) END, 9)"


def points(spark, sf_dir, neighbours):
    """The score at every true observation as it stood then, from that many hotspots."""
    s = points_then(spark, sf_dir, p=params.PointScore(neighbours=neighbours))
    return s.withColumn("score", F.round("score", 9))


@stored
def promotion_gate(spark, sf_dir):
    """Whether the nearest hotspot alone may replace the score of three, each as of the time of observation."""
    return trials.promotion(points(spark, sf_dir, 3), points(spark, sf_dir, 1))


MOVES = """inn AS (SELECT observed_date AS d, destination_id AS zone_id, arrival_hour AS hour, sum(flow) AS v FROM dated_flows GROUP BY 1, 2, 3),
outw AS (SELECT observed_date AS d, origin_id AS zone_id, departure_hour AS hour, sum(flow) AS v FROM dated_flows GROUP BY 1, 2, 3),
moved AS (SELECT coalesce(i.d, o.d) AS d, coalesce(i.zone_id, o.zone_id) AS zone_id, coalesce(i.hour, o.hour) AS hour, coalesce(i.v, 0) AS inb, coalesce(o.v, 0) AS outb, coalesce(i.v, 0) - coalesce(o.v, 0) AS net
  FROM inn i FULL JOIN outw o ON i.d = o.d AND i.zone_id = o.zone_id AND i.hour = o.hour)"""
WEEKS = f"""{MOVES},
vec AS (SELECT a.zone_id AS o, b.zone_id AS t, sin(radians(b.lng - a.lng)) * cos(radians(b.lat)) AS e, cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lng - a.lng)) AS n FROM od_centroids a CROSS JOIN od_centroids b),
head AS (SELECT f.observed_date AS d, destination_id AS zone_id, arrival_hour AS hour, sum(flow) AS elig, coalesce(sum(CASE WHEN v.o IS NOT NULL THEN flow END), 0) AS known,
  sum(flow * v.e / sqrt(v.e * v.e + v.n * v.n)) AS e, sum(flow * v.n / sqrt(v.e * v.e + v.n * v.n)) AS n
  FROM dated_flows f LEFT JOIN vec v ON v.o = f.origin_id AND v.t = f.destination_id WHERE origin_id <> destination_id GROUP BY 1, 2, 3),
dir AS (SELECT d, zone_id, hour, known / elig AS cover, least(1, sqrt(e * e + n * n) / known) AS strength, CASE WHEN sqrt(e * e + n * n) / known > 1e-9 THEN (degrees(atan2(e, n)) + 360) % 360 END AS bearing FROM head),
zone AS (SELECT m.*, cover, strength, bearing FROM moved m LEFT JOIN dir USING (d, zone_id, hour) WHERE hour IN (8, 14, 18)),
days AS (SELECT a.d FROM (SELECT DISTINCT d FROM zone) a JOIN (SELECT DISTINCT d FROM zone) b ON b.d = a.d + INTERVAL 7 DAY),
met AS (SELECT a.d, a.hour, a.zone_id, a.inb AS ai, b.inb AS bi, a.outb AS ao, b.outb AS bo, a.net AS an, b.net AS bn, a.strength AS s1, b.strength AS s2, a.bearing AS h1, b.bearing AS h2,
  coalesce(a.cover >= 0.95 AND b.cover >= 0.95 AND a.strength >= 0.2 AND b.strength >= 0.2 AND a.bearing IS NOT NULL AND b.bearing IS NOT NULL, false) AS ok
  FROM zone a JOIN zone b ON b.zone_id = a.zone_id AND b.hour = a.hour AND b.d = a.d + INTERVAL 7 DAY),
lone AS (SELECT p.d, z.hour, count(*) AS n FROM days p JOIN zone z ON z.d = p.d OR z.d = p.d + INTERVAL 7 DAY GROUP BY p.d, z.hour),
rk AS (SELECT *, {rank_sql('d, hour', 'ai')} AS rai, {rank_sql('d, hour', 'bi')} AS rbi, {rank_sql('d, hour', 'ao')} AS rao, {rank_sql('d, hour', 'bo')} AS rbo, {rank_sql('d, hour', 'an')} AS ran, {rank_sql('d, hour', 'bn')} AS rbn,
  ceil(count(*) OVER (PARTITION BY d, hour) * CAST(0.1 AS DOUBLE)) AS k,
  row_number() OVER (PARTITION BY d, hour ORDER BY an DESC, zone_id) AS t1, row_number() OVER (PARTITION BY d, hour ORDER BY bn DESC, zone_id) AS t2,
  row_number() OVER (PARTITION BY d, hour ORDER BY an, zone_id) AS u1, row_number() OVER (PARTITION BY d, hour ORDER BY bn, zone_id) AS u2,
  CASE WHEN ok THEN least(abs(h1 - h2) % 360, 360 - abs(h1 - h2) % 360) END AS gap FROM met),
flat AS (SELECT d, hour, count(*) AS zones, {rho_sql('rai', 'rbi')} AS inbound_rho, {rho_sql('rao', 'rbo')} AS outbound_rho, {rho_sql('ran', 'rbn')} AS net_rho,
  round(CAST(count(*) FILTER (WHERE t1 <= k AND t2 <= k) AS DOUBLE) / count(*) FILTER (WHERE t1 <= k OR t2 <= k), 9) AS top_jaccard,
  round(CAST(count(*) FILTER (WHERE u1 <= k AND u2 <= k) AS DOUBLE) / count(*) FILTER (WHERE u1 <= k OR u2 <= k), 9) AS bottom_jaccard,
  round(CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*), 9) AS eligible_share, round(quantile_cont(gap, 0.5), 6) AS angle_median, round(quantile_cont(gap, 0.9), 6) AS angle_p90,
  round(avg(CASE WHEN gap <= 45 THEN CAST(1 AS DOUBLE) WHEN gap > 45 THEN 0 END), 9) AS within_45, round(quantile_cont(CASE WHEN ok THEN abs(s1 - s2) END, 0.5), 9) AS strength_change FROM rk GROUP BY d, hour),
pp AS (SELECT observed_date AS d, arrival_hour AS hour, purpose, sum(flow) AS v FROM dated_flows GROUP BY 1, 2, 3),
pq AS (SELECT p.d, p.hour, p.purpose, p.v / sum(p.v) OVER w AS x, q.v / sum(q.v) OVER w AS y FROM pp p JOIN pp q ON q.d = p.d + INTERVAL 7 DAY AND q.hour = p.hour AND q.purpose = p.purpose WINDOW w AS (PARTITION BY p.d, p.hour)),
js AS (SELECT d, hour, round(sqrt(greatest(0, sum(x * log2(x / ((x + y) / 2)) + y * log2(y / ((x + y) / 2))) / 2)), 9) AS js_distance FROM pq GROUP BY d, hour),
weeks AS (SELECT CAST(f.d AS DATE) AS first_date, f.hour, f.zones, f.inbound_rho, f.outbound_rho, f.net_rho, f.top_jaccard, f.bottom_jaccard, f.eligible_share, f.angle_median, f.angle_p90, f.within_45, f.strength_change, l.n - 2 * f.zones AS unmatched, js.js_distance
  FROM flat f JOIN lone l ON l.d = f.d AND l.hour = f.hour JOIN js ON js.d = f.d AND js.hour = f.hour)"""


def weeks(spark, sf_dir):
    return trials.weekly_stability(load(spark, sf_dir, "dated_flows"), load(spark, sf_dir, "od_centroids"))


@query(f"WITH {WEEKS} SELECT * FROM weeks")
def od_stability(spark, sf_dir):
    return weeks(spark, sf_dir)


@query(f"""WITH {WEEKS}, s AS (SELECT count(*) AS pairs, CAST(sum(unmatched) AS BIGINT) AS unmatched, round(median(net_rho), 9) AS net_rho_median, round(median(inbound_rho), 9) AS inbound_rho_median, round(median(outbound_rho), 9) AS outbound_rho_median,
  round(median(top_jaccard), 9) AS top_jaccard_median, round(median(bottom_jaccard), 9) AS bottom_jaccard_median, round(median(js_distance), 9) AS js_distance_median, min(net_rho) AS net_rho_least,
  quantile_cont(js_distance, 0.9) AS jp, count(angle_median) AS angles, max(angle_median) AS am, max(angle_p90) AS ap, min(eligible_share) AS es, min(within_45) AS w, max(strength_change) AS sc,
  count(net_rho) = count(*) AND count(inbound_rho) = count(*) AND count(outbound_rho) = count(*) AND sum(unmatched) = 0 AS whole FROM weeks)
SELECT pairs, unmatched, net_rho_median, inbound_rho_median, outbound_rho_median, top_jaccard_median, bottom_jaccard_median, js_distance_median, net_rho_least,
  CASE WHEN whole AND net_rho_median >= 0.8 AND net_rho_least >= 0.6 AND inbound_rho_median >= 0.85 AND outbound_rho_median >= 0.85 AND top_jaccard_median >= 0.5 AND bottom_jaccard_median >= 0.5 THEN 'supported'
    WHEN whole AND net_rho_median >= 0.6 AND net_rho_least >= 0.5 THEN 'conditional' ELSE 'not_supported' END AS scalar,
  CASE WHEN js_distance_median <= 0.05 AND jp <= 0.1 THEN 'stable' ELSE 'not_stable' END AS purpose,
  CASE WHEN angles = pairs AND am <= 30 AND ap <= 75 AND es >= 0.2 AND w >= 0.7 AND sc <= 0.1 THEN 'usable' ELSE 'not_usable' END AS vector FROM s""")
def od_stability_verdict(spark, sf_dir):
    return trials.stability_verdict(weeks(spark, sf_dir))


SCREEN = f"""{MOVES},
h AS (SELECT * FROM (VALUES (8), (14), (18)) v(hour)),
st AS (SELECT observed_date AS d, zone_id, cell_id, hour, masked, CASE WHEN masked THEN 0 ELSE population END AS known FROM cell_stock),
u AS (SELECT h.hour, s.step, st.d, st.zone_id, st.cell_id, max(CASE WHEN st.hour = h.hour + least(s.step, 0) THEN known END) AS k0, max(CASE WHEN st.hour = h.hour + greatest(s.step, 0) THEN known END) AS k1,
  coalesce(bool_or(masked AND st.hour = h.hour + least(s.step, 0)), false) AS m0, coalesce(bool_or(masked AND st.hour = h.hour + greatest(s.step, 0)), false) AS m1
  FROM h CROSS JOIN (VALUES (-1), (1)) s(step) JOIN st ON st.hour IN (h.hour, h.hour + s.step) GROUP BY 1, 2, 3, 4, 5),
lik AS (SELECT d, hour, round(min(j), 9) AS cell_jaccard FROM (SELECT d, hour, step, count(*) FILTER (WHERE l AND r) / CAST(count(*) AS DOUBLE) AS j
  FROM (SELECT d, hour, step, cell_id, bool_or(k0 IS NOT NULL) AS l, bool_or(k1 IS NOT NULL) AS r FROM u GROUP BY 1, 2, 3, 4) c GROUP BY 1, 2, 3) x GROUP BY d, hour),
whole AS (SELECT d, zone_id, h.hour FROM st JOIN h ON st.hour BETWEEN h.hour - 1 AND h.hour + 1 GROUP BY 1, 2, 3 HAVING count(DISTINCT st.hour) = 3),
cov AS (SELECT m.d, m.hour, round(count(w.zone_id) / CAST(count(*) AS DOUBLE), 9) AS code_coverage FROM moved m LEFT JOIN whole w ON w.d = m.d AND w.zone_id = m.zone_id AND w.hour = m.hour GROUP BY m.d, m.hour),
var AS (SELECT * FROM (VALUES ('mask2_absent0', 2, 0), ('mask0_absent0', 0, 0), ('mask3_absent0', 3, 0), ('mask2_absent2', 2, 2), ('mask2_absent3', 2, 3)) v(variant, mk, ab)),
dl AS (SELECT u.d, u.hour, u.step, u.zone_id, variant, count(*) AS n, count(*) FILTER (WHERE k0 IS NULL) AS a0, count(*) FILTER (WHERE k1 IS NULL) AS a1,
  sum(coalesce(k1 + CASE WHEN m1 THEN mk ELSE 0 END, ab) - coalesce(k0 + CASE WHEN m0 THEN mk ELSE 0 END, ab)) AS change, sum(k0 + CASE WHEN m0 THEN mk ELSE 0 END) AS stock FROM u CROSS JOIN var GROUP BY 1, 2, 3, 4, 5),
x AS (SELECT m.d, m.hour, m.zone_id, a.variant, m.net, m.inb + m.outb AS gross, a.change AS nxt, b.change AS lst, a.stock, a.n, a.a0, a.a1
  FROM moved m JOIN whole w ON w.d = m.d AND w.zone_id = m.zone_id AND w.hour = m.hour JOIN dl a ON a.d = m.d AND a.hour = m.hour AND a.zone_id = m.zone_id AND a.step = 1
  JOIN dl b ON b.d = m.d AND b.hour = m.hour AND b.zone_id = m.zone_id AND b.step = -1 AND b.variant = a.variant),
xr AS (SELECT *, {rank_sql('d, hour, variant', 'net')} AS r1, {rank_sql('d, hour, variant', 'nxt')} AS r2, {rank_sql('d, hour, variant', 'lst')} AS r3, {rank_sql('d, hour, variant', 'gross')} AS r4, {rank_sql('d, hour, variant', 'stock')} AS r5 FROM x),
scr AS (SELECT CAST(xr.d AS DATE) AS observed_date, xr.hour, variant, count(*) AS zones, {rho_sql('r1', 'r2')} AS rho, {rho_sql('r1', 'r3')} AS rho_before, {rho_sql('r4', 'r5')} AS rho_gross,
  CAST(sum(n) AS BIGINT) AS cells, CAST(sum(a0) AS BIGINT) AS absent_now, CAST(sum(a1) AS BIGINT) AS absent_next, max(code_coverage) AS code_coverage, max(cell_jaccard) AS cell_jaccard, max(code_coverage) >= 0.95 AND max(cell_jaccard) >= 0.99 AS gates
  FROM xr JOIN cov ON cov.d = xr.d AND cov.hour = xr.hour JOIN lik ON lik.d = xr.d AND lik.hour = xr.hour GROUP BY xr.d, xr.hour, variant)"""
DAYS = f"""{SCREEN},
vv AS (SELECT observed_date, variant, median(rho) AS md, min(rho) AS least, count(*) FILTER (WHERE rho > 0) AS positive, count(rho) AS defined,
  CASE WHEN count(rho) = 3 AND min(rho) > 0 AND median(rho) >= 0.3 THEN 'screening' WHEN count(rho) = 3 AND median(rho) >= 0.2 AND count(*) FILTER (WHERE rho > 0) >= 2 THEN 'conditional' ELSE 'not_supported' END AS verdict FROM scr GROUP BY 1, 2),
rg AS (SELECT observed_date, max(r) AS r, bool_and(g) AS g FROM (SELECT observed_date, hour, CASE WHEN count(rho) = 5 THEN max(rho) - min(rho) END AS r, bool_and(gates) AS g FROM scr GROUP BY 1, 2) y GROUP BY 1),
dist AS (SELECT observed_date, count(DISTINCT verdict) AS n FROM vv GROUP BY 1),
days AS (SELECT vv.observed_date, vv.verdict AS base_verdict, round(md, 9) AS median, least, positive, defined, round(r, 9) AS rho_range, coalesce(round(r, 9) > 0.02, false) OR n > 1 AS sensitive,
  CASE WHEN NOT g THEN 'rejected' WHEN NOT (coalesce(round(r, 9) > 0.02, false) OR n > 1) THEN vv.verdict WHEN vv.verdict = 'screening' THEN 'conditional' ELSE 'not_supported' END AS verdict
  FROM vv JOIN rg ON rg.observed_date = vv.observed_date JOIN dist ON dist.observed_date = vv.observed_date WHERE vv.variant = 'mask2_absent0')"""


def screen(spark, sf_dir):
    return trials.same_day(load(spark, sf_dir, "cell_stock"), load(spark, sf_dir, "dated_flows"))


@query(f"WITH {SCREEN} SELECT * FROM scr")
def stock_flow_screen(spark, sf_dir):
    return screen(spark, sf_dir)


@query(f"WITH {DAYS} SELECT * FROM days")
def stock_flow_verdict(spark, sf_dir):
    return trials.same_day_verdict(screen(spark, sf_dir))


@query(f"""WITH {DAYS}, held AS (SELECT * FROM days WHERE observed_date IN (DATE '2024-01-02', DATE '2024-01-09', DATE '2024-01-16')),
a AS (SELECT count(*) AS days, count(*) FILTER (WHERE verdict = 'rejected') AS rejected, count(*) FILTER (WHERE base_verdict = 'screening') AS screening_days, count(*) FILTER (WHERE base_verdict <> 'not_supported') AS conditional_days, bool_or(sensitive) AS sensitive FROM held),
b AS (SELECT count(rho) AS defined, round(median(rho), 9) AS median, min(rho) AS least, count(*) FILTER (WHERE rho > 0) AS positive FROM scr WHERE variant = 'mask2_absent0' AND observed_date IN (DATE '2024-01-02', DATE '2024-01-09', DATE '2024-01-16')),
c AS (SELECT *, CASE WHEN days = 3 AND rejected = 0 AND defined = 9 AND screening_days = 3 AND median >= 0.3 AND least > 0 THEN 'supported' WHEN days = 3 AND rejected = 0 AND defined = 9 AND conditional_days >= 2 AND median >= 0.2 AND positive >= 7 THEN 'conditional' ELSE 'not_supported' END AS base_verdict FROM a CROSS JOIN b)
SELECT *, CASE WHEN NOT sensitive THEN base_verdict WHEN base_verdict = 'supported' THEN 'conditional' ELSE 'not_supported' END AS verdict FROM c""")
def heldout_repeats(spark, sf_dir):
    roles = spark.createDataFrame(ROLES, "observed_date string, role string").withColumn("observed_date", F.to_date("observed_date"))
    return trials.held_out(screen(spark, sf_dir), roles)

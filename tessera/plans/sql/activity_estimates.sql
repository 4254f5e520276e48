WITH
-- include near_of
, base AS (SELECT hotspot_id, avg(ppltn_min) AS mean, CASE WHEN hotspot_id % 9 = 0 THEN NULL ELSE stddev_pop(ln(1 + CAST(ppltn_min AS DOUBLE))) END AS spread FROM snapshots GROUP BY hotspot_id),
c AS (
  SELECT n.*, b.mean, b.spread, CASE WHEN n.hotspot_id % 37 = 0 THEN 0 ELSE 1 / pow(greatest(d, 50), 2) END AS w, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(observed_at)) / CAST(60000000 AS DOUBLE) > 720 AS stale,
    CASE WHEN n.hotspot_id % 41 = 0 THEN 'reference_raw_n' WHEN n.hotspot_id % 37 = 0 THEN 'weight' WHEN fetched_at > TIMESTAMP '2024-01-31 00:02:00' THEN 'fetched_in_the_future' END AS fault, ln(1 + CAST(ppltn_min AS DOUBLE)) - ln(1 + mean) AS a, ln(1 + CAST(ppltn_max AS DOUBLE)) - ln(1 + mean) AS b
  FROM near n JOIN base b ON b.hotspot_id = n.hotspot_id),
x AS (SELECT *, CASE WHEN spread >= 1e-6 THEN greatest(-5, least(5, a / spread)) END AS sa, CASE WHEN spread >= 1e-6 THEN greatest(-5, least(5, b / spread)) END AS sb, sum(w) OVER (PARTITION BY cafe_id) AS ws FROM c),
e AS (
  SELECT cafe_id, count(*) AS n, arg_min(fault, CAST(hotspot_id AS VARCHAR)) FILTER (WHERE fault IS NOT NULL) AS own, count(*) FILTER (WHERE stale) AS old, sum(w * a) / sum(w) AS a, sum(w * b) / sum(w) AS b,
    CASE WHEN count(sa) = count(*) THEN sum(w * sa) / sum(w) END AS sa, CASE WHEN count(sb) = count(*) THEN sum(w * sb) / sum(w) END AS sb, max(mean) AS mean, max(ppltn_min) AS low FROM x GROUP BY cafe_id),
s AS (SELECT x.cafe_id, sqrt(sum(w * pow((x.a + x.b) / 2 - (e.a + e.b) / 2, 2)) / sum(w)) AS disagreement FROM x JOIN e ON e.cafe_id = x.cafe_id GROUP BY x.cafe_id),
t AS (SELECT e.*, disagreement, coalesce(own, CASE WHEN old > 0 AND old < n THEN 'fresh_and_stale' END) AS error FROM e JOIN s ON s.cafe_id = e.cafe_id)
SELECT cafe_id AS estimate_id, error, n, CASE WHEN error IS NULL THEN CASE WHEN old > 0 THEN 'stale' ELSE 'fresh' END END AS freshness, CASE WHEN error IS NULL AND n = 1 THEN round(mean, 6) END AS baseline_mean,
  CASE WHEN error IS NULL AND old = 0 AND n = 1 THEN CAST(low AS DOUBLE) END AS current_min, CASE WHEN error IS NULL AND old = 0 THEN round(a, 7) END AS anomaly_min, CASE WHEN error IS NULL AND old = 0 THEN round(b, 7) END AS anomaly_max,
  CASE WHEN error IS NULL AND old = 0 THEN round(sa, 6) END AS standardized_min, CASE WHEN error IS NULL AND old = 0 THEN round(disagreement, 6) END AS disagreement FROM t

WITH
-- include scores_then
, j AS (
  SELECT t.slot, t.observed_area_level AS truth, s.coverage, round(s.score, 9) AS bs, s.level AS bl, round(s.lone_score, 9) AS cs, s.lone_level AS cl
  FROM truths t LEFT JOIN past s ON s.cafe_id = t.cafe_id AND s.observed_at = t.observed_at),
keys AS (SELECT count(*) AS n, count(DISTINCT (cafe_id, observed_at, slot)) AS k FROM truths),
lost AS (SELECT count(*) AS n FROM j WHERE bs IS NOT NULL AND cs IS NULL),
seg AS (
  SELECT 'overall' AS segment, * FROM j WHERE bs IS NOT NULL AND cs IS NOT NULL
  UNION ALL SELECT coverage AS segment, * FROM j WHERE bs IS NOT NULL AND cs IS NOT NULL AND coverage IN ('covered', 'fringe')),
r AS (
  SELECT segment, slot, rank() OVER (PARTITION BY segment, slot ORDER BY bs) + (count(*) OVER (PARTITION BY segment, slot, bs) - 1) / CAST(2 AS DOUBLE) AS b,
    rank() OVER (PARTITION BY segment, slot ORDER BY cs) + (count(*) OVER (PARTITION BY segment, slot, cs) - 1) / CAST(2 AS DOUBLE) AS c,
    rank() OVER (PARTITION BY segment, slot ORDER BY truth) + (count(*) OVER (PARTITION BY segment, slot, truth) - 1) / CAST(2 AS DOUBLE) AS t FROM seg),
sums AS (
  SELECT segment, slot, count(*) AS n, sum(b) AS b, sum(c) AS c, sum(t) AS t, sum(b * b) AS bb, sum(c * c) AS cc, sum(t * t) AS tt, sum(b * t) AS bt, sum(c * t) AS ct FROM r GROUP BY segment, slot),
slots AS (
  SELECT segment, slot, CASE WHEN (n * bb - b * b) * (n * tt - t * t) > 0 THEN (n * bt - b * t) / sqrt((n * bb - b * b) * (n * tt - t * t)) END AS b,
    CASE WHEN (n * cc - c * c) * (n * tt - t * t) > 0 THEN (n * ct - c * t) / sqrt((n * cc - c * c) * (n * tt - t * t)) END AS c FROM sums),
rho AS (SELECT segment, round(avg(b), 9) AS rb, round(avg(c), 9) AS rc FROM slots GROUP BY segment),
adj AS (
  SELECT segment, round(avg(CASE WHEN abs(bl - truth) <= 1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS nb, round(avg(CASE WHEN abs(cl - truth) <= 1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS nc FROM seg GROUP BY segment),
m AS (SELECT adj.segment, rb, rc, nb, nc, rc >= rb AND nc >= nb AS steady FROM adj JOIN rho ON rho.segment = adj.segment),
checks AS (
  SELECT 'identical_primary_rows' AS name, n = k AS ok FROM keys
  UNION ALL SELECT 'no_coverage_loss', n = 0 FROM lost
  UNION ALL SELECT 'overall_spearman', coalesce(bool_and(rc >= 0.5 AND rc >= rb), false) FROM m WHERE segment = 'overall'
  UNION ALL SELECT 'overall_adjacent_accuracy', coalesce(bool_and(nc >= 0.8 AND nc >= nb), false) FROM m WHERE segment = 'overall'
  UNION ALL SELECT 'covered_no_serious_regression', coalesce(bool_and(steady), false) FROM m WHERE segment = 'covered'
  UNION ALL SELECT 'fringe_no_serious_regression', coalesce(bool_and(steady), false) FROM m WHERE segment = 'fringe'
  UNION ALL SELECT 'fringe_improvement_evidence', coalesce(bool_and(rc > rb OR nc > nb), false) FROM m WHERE segment = 'fringe')
SELECT name AS "check", ok AS passed FROM checks UNION ALL SELECT 'promoted', bool_and(ok) FROM checks

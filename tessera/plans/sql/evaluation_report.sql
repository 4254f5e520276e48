WITH
-- include scores_then
, p AS (SELECT t.slot, t.observed_area_level AS truth, s.* FROM truths t JOIN past s ON s.cafe_id = t.cafe_id AND s.observed_at = t.observed_at),
g AS (
  SELECT slot, rank() OVER (PARTITION BY slot ORDER BY round(score, 9)) + (count(*) OVER (PARTITION BY slot, round(score, 9)) - 1) / CAST(2 AS DOUBLE) AS x, rank() OVER (PARTITION BY slot ORDER BY truth) + (count(*) OVER (PARTITION BY slot, truth) - 1) / CAST(2 AS DOUBLE) AS y
  FROM p WHERE score IS NOT NULL),
rho AS (
  SELECT slot, CASE WHEN (count(*) * sum(x * x) - sum(x) * sum(x)) * (count(*) * sum(y * y) - sum(y) * sum(y)) > 0 THEN (count(*) * sum(x * y) - sum(x) * sum(y)) / sqrt((count(*) * sum(x * x) - sum(x) * sum(x)) * (count(*) * sum(y * y) - sum(y) * sum(y))) END AS rho FROM g GROUP BY slot),
first AS (SELECT cafe_id, slot, arg_min(observed_area_level, observed_at) AS a, arg_min(reliability_level, observed_at) AS b FROM truths GROUP BY cafe_id, slot),
o AS (SELECT count(*) AS n, avg(1 - pow((a - b) / CAST(3 AS DOUBLE), 2)) AS po, count(DISTINCT a) AS da, count(DISTINCT b) AS db FROM first),
e AS (SELECT avg(1 - pow((x.a - y.b) / CAST(3 AS DOUBLE), 2)) AS pe FROM first x CROSS JOIN first y)
SELECT (SELECT count(*) FROM p) AS rows, (SELECT count(*) FROM p WHERE coverage = 'uncovered') AS uncovered, (SELECT count(*) FROM p WHERE score IS NOT NULL) AS observations,
  (SELECT round(avg(CASE WHEN abs(level - truth) <= 1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) FROM p WHERE score IS NOT NULL) AS adjacent_accuracy, (SELECT round(avg(rho), 7) FROM rho) AS spearman, (SELECT count(rho) FROM rho) AS slots,
  (SELECT n FROM o) AS pairs, (SELECT round(CASE WHEN n >= 2 AND da > 1 AND db > 1 AND pe < 1 THEN (po - pe) / (1 - pe) END, 9) FROM o CROSS JOIN e) AS kappa

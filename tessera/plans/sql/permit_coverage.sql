WITH
-- include strong_of
, counted AS (SELECT *, count(*) OVER (PARTITION BY permit_id) AS n FROM strong),
claims AS (SELECT cafe_id, count(*) AS claims FROM counted WHERE n = 1 GROUP BY cafe_id),
sure AS (
  SELECT c.*, k.claims, CASE WHEN by_name AND by_phone THEN 'both' WHEN by_name THEN 'name_only' ELSE 'phone_only' END AS rule, f.origin_provider, p.area
  FROM counted c JOIN claims k ON k.cafe_id = c.cafe_id JOIN cafe_places f ON f.cafe_id = c.cafe_id JOIN permit_places p ON p.permit_id = c.permit_id WHERE c.n = 1),
verified AS (SELECT * FROM sure WHERE claims = 1)
SELECT (SELECT count(*) FROM permit_places) AS permits, (SELECT count(*) FROM verified) AS verified,
  (SELECT count(*) FROM permit_places WHERE permit_id NOT IN (SELECT permit_id FROM strong)) AS missing,
  (SELECT count(DISTINCT permit_id) FROM counted WHERE n > 1) + (SELECT count(*) FROM sure WHERE claims > 1) AS ambiguous,
  (SELECT count(*) FROM verified WHERE rule = 'name_only') AS name_only, (SELECT count(*) FROM verified WHERE rule = 'phone_only') AS phone_only, (SELECT count(*) FROM verified WHERE rule = 'both') AS both,
  (SELECT count(*) FROM sure WHERE claims > 1) AS colliding_permits, (SELECT count(DISTINCT origin_provider) FROM verified) AS providers,
  (SELECT min(area) FROM verified) AS area_min, (SELECT max(area) FROM verified) AS area_max,
  (SELECT quantile_disc(area, 0.01) FROM verified) AS area_p1, (SELECT quantile_disc(area, 0.05) FROM verified) AS area_p5, (SELECT quantile_disc(area, 0.5) FROM verified) AS area_p50,
  (SELECT quantile_disc(area, 0.95) FROM verified) AS area_p95, (SELECT quantile_disc(area, 0.99) FROM verified) AS area_p99

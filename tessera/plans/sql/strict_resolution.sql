WITH
-- include strong_of
, counted AS (SELECT *, count(*) OVER (PARTITION BY permit_id) AS n FROM strong),
claims AS (SELECT cafe_id, count(*) AS claims FROM counted WHERE n = 1 GROUP BY cafe_id),
judged AS (
  SELECT c.permit_id, max(c.n) AS n, min(c.cafe_id) AS cafe_id, max(CASE WHEN by_name AND by_phone THEN 'both' WHEN by_name THEN 'name_only' ELSE 'phone_only' END) AS rule, min(d) AS d, max(coalesce(k.claims, 0)) AS claims
  FROM counted c LEFT JOIN claims k ON c.n = 1 AND k.cafe_id = c.cafe_id GROUP BY c.permit_id),
told AS (
  SELECT p.permit_id, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 AND claims = 1 THEN 'verified' ELSE 'ambiguous' END AS status, j.cafe_id, j.rule, j.d, coalesce(n, 0) AS strong, coalesce(n = 1 AND claims > 1, false) AS collides
  FROM permit_places p LEFT JOIN judged j ON j.permit_id = p.permit_id)
SELECT permit_id, status, CASE WHEN status = 'verified' THEN cafe_id END AS cafe_id, CASE WHEN status = 'verified' THEN rule END AS rule,
  CASE WHEN status = 'verified' THEN round(d, 3) END AS distance_m, strong, collides FROM told

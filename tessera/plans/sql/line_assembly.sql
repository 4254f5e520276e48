WITH RECURSIVE
ends AS (
  SELECT line_id, lng, least(lat_a, lat_b) AS p, greatest(lat_a, lat_b) AS q FROM track_ways WHERE b IS NOT NULL),
parts AS (
  SELECT *, row_number() OVER (ORDER BY line_id, lng, p, q) AS part FROM (SELECT DISTINCT line_id, lng, p, q FROM ends) e),
darts AS (
  SELECT line_id, lng, 2 * part AS dart, p AS tail, q AS head FROM parts UNION ALL SELECT line_id, lng, 2 * part + 1, q, p FROM parts),
joints AS (SELECT line_id, lng, tail AS at FROM darts GROUP BY line_id, lng, tail HAVING count(*) = 2),
hops AS (
  SELECT d.dart, o.dart AS next FROM darts d JOIN joints j ON j.line_id = d.line_id AND j.lng = d.lng AND j.at = d.head
  JOIN darts o ON o.line_id = d.line_id AND o.lng = d.lng AND o.tail = d.head AND xor(o.dart, 1) <> d.dart),
firsts AS (SELECT dart FROM darts WHERE dart NOT IN (SELECT next FROM hops)),
paths AS (
  SELECT f.dart AS start, d.dart, d.line_id, d.lng, 1 AS n, [d.tail, (d.tail + d.head) / 2, d.head] AS lats FROM firsts f JOIN darts d ON d.dart = f.dart
  UNION ALL
  SELECT w.start, d.dart, w.line_id, w.lng, w.n + 1, w.lats || [(d.tail + d.head) / 2, d.head] FROM paths w JOIN hops h ON h.dart = w.dart JOIN darts d ON d.dart = h.next),
loose AS (SELECT d.* FROM darts d WHERE d.dart NOT IN (SELECT dart FROM paths)),
rings AS (
  SELECT d.dart AS start, d.dart, d.line_id, d.lng, d.tail AS least_lat, 1 AS n, [d.tail, (d.tail + d.head) / 2, d.head] AS lats FROM loose d
  UNION ALL
  SELECT w.start, d.dart, w.line_id, w.lng, least(w.least_lat, d.tail), w.n + 1, w.lats || [(d.tail + d.head) / 2, d.head]
  FROM rings w JOIN hops h ON h.dart = w.dart JOIN darts d ON d.dart = h.next WHERE h.next <> w.start),
whole AS (
  SELECT line_id, lng, lats, n, false AS closed FROM (SELECT *, max(n) OVER (PARTITION BY start) AS most FROM paths) p WHERE n = most
  UNION ALL
  SELECT line_id, lng, lats, n, true FROM (SELECT *, max(n) OVER (PARTITION BY start) AS most FROM rings) r WHERE n = most AND lats[1] = least_lat),
text AS (SELECT line_id, lng, n, closed, least(lats, list_reverse(lats)) AS lats FROM whole)
SELECT DISTINCT line_id, CAST(n AS INT) AS parts, closed, CAST(len(lats) AS INT) AS points, CAST((lng - 126) * 1024 AS BIGINT) AS x,
  array_to_string(list_transform(lats, lambda v: CAST(CAST((v - 37) * 128 AS BIGINT) AS VARCHAR)), ' ') AS ys FROM text

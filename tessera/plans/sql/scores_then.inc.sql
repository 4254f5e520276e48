asked AS (SELECT DISTINCT cafe_id, observed_at AS t FROM truths),
reach AS (
  SELECT a.cafe_id, a.t, h.hotspot_id, 2 * 6371008.8 * asin(sqrt(least(CAST(1 AS DOUBLE), pow(sin(radians(h.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(h.lat)) * pow(sin(radians(h.lng - c.lng) / 2), 2)))) AS d
  FROM asked a JOIN cafes c ON c.cafe_id = a.cafe_id JOIN hotspots h ON h.is_polled),
seen AS (
  SELECT r.*, s.level, s.observed_at, row_number() OVER (PARTITION BY r.cafe_id, r.t, r.hotspot_id ORDER BY s.observed_at DESC, s.event_id DESC) AS rn
  FROM reach r JOIN snapshots s ON s.hotspot_id = r.hotspot_id AND s.observed_at <= r.t AND s.fetched_at <= r.t WHERE d <= 1500),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cafe_id, t ORDER BY d, hotspot_id) AS rank FROM seen WHERE rn = 1),
made AS (SELECT cafe_id, t, sum(level / pow(greatest(d, 50), 2)) / sum(1 / pow(greatest(d, 50), 2)) AS score, min(d) AS nearest FROM ranked WHERE rank <= 3 GROUP BY cafe_id, t),
lone AS (SELECT cafe_id, t, CAST(level AS DOUBLE) AS score, level FROM ranked WHERE rank = 1),
past AS (
  SELECT a.cafe_id, a.t AS observed_at, m.score, CAST(CASE WHEN m.score IS NOT NULL THEN greatest(1, least(4, floor(m.score + 0.5))) END AS INT) AS level, CASE WHEN nearest IS NULL THEN 'uncovered' WHEN nearest <= 600 THEN 'covered' ELSE 'fringe' END AS coverage,
    l.score AS lone_score, l.level AS lone_level FROM asked a LEFT JOIN made m ON m.cafe_id = a.cafe_id AND m.t = a.t LEFT JOIN lone l ON l.cafe_id = a.cafe_id AND l.t = a.t)

latest AS (
  SELECT * FROM (SELECT s.*, h.lat, h.lng, row_number() OVER (PARTITION BY s.hotspot_id ORDER BY s.observed_at DESC, s.event_id DESC) AS rn FROM snapshots s JOIN hotspots h ON h.hotspot_id = s.hotspot_id WHERE h.is_polled) x WHERE rn = 1),
near AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cafe_id ORDER BY d, hotspot_id) AS rank FROM (
    SELECT c.cafe_id, c.active, l.hotspot_id, l.level, l.observed_at, l.fetched_at, l.ppltn_min, l.ppltn_max,
      2 * 6371008.8 * asin(sqrt(least(CAST(1 AS DOUBLE), pow(sin(radians(l.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(l.lat)) * pow(sin(radians(l.lng - c.lng) / 2), 2)))) AS d
    FROM cafes c CROSS JOIN latest l) p WHERE d <= 1500) x WHERE rank <= 3)

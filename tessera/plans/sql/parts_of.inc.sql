half AS (SELECT hotspot_id, lat, lng, 0.002 + CAST(hotspot_id % 5 AS DOUBLE) * 0.001 AS d FROM hotspots WHERE is_polled),
boxes AS (
  SELECT hotspot_id, 1 AS sign, lat - d AS y0, lat + d AS y1, lng - d AS x0, lng + d AS x1 FROM half
  UNION ALL SELECT hotspot_id, -1, lat - d / 2, lat + d / 2, lng - d / 2, lng + d / 2 FROM half
  UNION ALL SELECT hotspot_id, 1, lat + 0.02 - d / 2, lat + 0.02 + d / 2, lng - d / 2, lng + d / 2 FROM half)

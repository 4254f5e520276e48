WITH
-- include parts_of
, cells AS (SELECT y * 100 + x AS cell_id, 37.43 + y * 0.01 AS cy, 126.80 + x * 0.01 AS cx FROM (SELECT unnest(range(0, 27)) AS y) a CROSS JOIN (SELECT unnest(range(0, 36)) AS x) b),
o AS (
  SELECT hotspot_id, cell_id, sum(sign * greatest(0, least(y1, cy + 0.01) - greatest(y0, cy)) * greatest(0, least(x1, cx + 0.01) - greatest(x0, cx)) / (0.01 * 0.01)) AS weight
  FROM boxes CROSS JOIN cells GROUP BY hotspot_id, cell_id)
SELECT hotspot_id, CAST(cell_id AS BIGINT) AS cell_id, round(weight, 6) AS weight FROM o WHERE weight > 1e-7

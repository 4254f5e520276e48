WITH
f AS (
  SELECT m.*, a.zone_id IS NOT NULL AS ok, b.zone_id IS NOT NULL AS dk FROM moves_of_day m LEFT JOIN od_centroids a ON a.zone_id = m.origin_id LEFT JOIN od_centroids b ON b.zone_id = m.destination_id
  WHERE departure_hour IN (8, 14) OR arrival_hour IN (8, 14)),
z AS (SELECT DISTINCT zone, known FROM (SELECT origin_id AS zone, ok AS known FROM f UNION ALL SELECT destination_id, dk FROM f) u)
SELECT (SELECT count(*) FROM moves_of_day) AS rows_scanned, count(*) AS rows, round(sum(flow), 6) AS flow, count(*) FILTER (WHERE ok AND dk) AS placed_rows, round(count(*) FILTER (WHERE ok AND dk) / count(*), 9) AS placed_row_ratio,
  round(coalesce(sum(flow) FILTER (WHERE ok AND dk), 0) / sum(flow), 9) AS placed_flow_ratio, count(*) FILTER (WHERE origin_id = destination_id) AS intrazonal_rows,
  coalesce(string_agg(DISTINCT CAST(origin_id AS VARCHAR), ',' ORDER BY CAST(origin_id AS VARCHAR)) FILTER (WHERE NOT ok), '') AS missing_origins,
  coalesce(string_agg(DISTINCT CAST(destination_id AS VARCHAR), ',' ORDER BY CAST(destination_id AS VARCHAR)) FILTER (WHERE NOT dk), '') AS missing_destinations,
  (SELECT count(*) FROM z) AS zones, (SELECT count(*) FROM z WHERE known) AS placed_zones FROM f

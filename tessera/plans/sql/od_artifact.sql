WITH
f AS (
  SELECT m.*, a.zone_id IS NOT NULL AND b.zone_id IS NOT NULL AS placed, CASE WHEN a.zone_id <> b.zone_id THEN sin(radians(b.lng - a.lng)) * cos(radians(b.lat)) END AS e,
    CASE WHEN a.zone_id <> b.zone_id THEN cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lng - a.lng)) END AS n
  FROM moves_of_day m LEFT JOIN od_centroids a ON a.zone_id = m.origin_id LEFT JOIN od_centroids b ON b.zone_id = m.destination_id WHERE departure_hour IN (8, 14) OR arrival_hour IN (8, 14)),
inn AS (
  SELECT destination_id AS zone_id, arrival_hour AS hour, sum(flow) AS inbound, count(*) AS total_rows, count(*) FILTER (WHERE placed) AS placed_rows, coalesce(sum(flow) FILTER (WHERE placed), 0) AS placed_flow,
    sum(flow * distance_m) AS distance, sum(flow * duration_min) AS duration, coalesce(sum(flow) FILTER (WHERE origin_id = destination_id), 0) AS intra,
    sum(flow) FILTER (WHERE origin_id <> destination_id) AS eligible, coalesce(sum(flow) FILTER (WHERE e IS NOT NULL), 0) AS known, sum(flow * e / sqrt(e * e + n * n)) AS e, sum(flow * n / sqrt(e * e + n * n)) AS n
  FROM f GROUP BY 1, 2),
outw AS (SELECT origin_id AS zone_id, departure_hour AS hour, sum(flow) AS outbound, coalesce(sum(flow) FILTER (WHERE origin_id = destination_id), 0) AS intra FROM f GROUP BY 1, 2),
pur AS (
  SELECT zone_id, hour, string_agg(concat(purpose, ':', CAST(round(v * 1000) AS BIGINT), ':', CAST(round(v / total * 1000000) AS BIGINT)), ',' ORDER BY purpose) AS purposes FROM (
    SELECT destination_id AS zone_id, arrival_hour AS hour, purpose, sum(flow) AS v, sum(sum(flow)) OVER (PARTITION BY destination_id, arrival_hour) AS total FROM f GROUP BY 1, 2, 3) p GROUP BY 1, 2),
z AS (
  SELECT coalesce(i.zone_id, o.zone_id) AS zone_id, coalesce(i.hour, o.hour) AS hour, coalesce(inbound, 0) AS inbound, coalesce(outbound, 0) AS outbound, coalesce(i.intra, 0) AS intra_in, coalesce(o.intra, 0) AS intra_out,
    total_rows, placed_rows, placed_flow, distance, duration, eligible, known, e, n FROM inn i FULL JOIN outw o ON i.zone_id = o.zone_id AND i.hour = o.hour)
SELECT z.zone_id, c.name, z.hour, printf('%02d:00', z.hour) AS local_time, round(inbound, 6) AS inbound, round(outbound, 6) AS outbound, round(inbound - outbound, 6) AS net, round(intra_in, 6) AS intrazonal_inbound, round(intra_out, 6) AS intrazonal_outbound,
  coalesce(p.purposes, '') AS purposes, CASE WHEN inbound > 0 THEN round(distance / inbound, 6) END AS mean_distance_m, CASE WHEN inbound > 0 THEN round(duration / inbound, 6) END AS mean_duration_min, c.lat,
  coalesce(placed_rows, 0) AS placed_rows, coalesce(total_rows, 0) AS total_rows, CASE WHEN inbound > 0 THEN round(placed_flow / inbound, 9) END AS placed_ratio,
  round(round(CASE WHEN known > 0 THEN least(1, sqrt(e * e + n * n) / known) END, 9), 6) AS strength, round(round(CASE WHEN known > 0 AND sqrt(e * e + n * n) / known > 1e-9 THEN (degrees(atan2(e, n)) + 360) % 360 END, 6), 3) AS heading_deg,
  round(coalesce(known / eligible, 0), 9) AS direction_coverage
FROM z LEFT JOIN pur p ON p.zone_id = z.zone_id AND p.hour = z.hour LEFT JOIN od_centroids c ON c.zone_id = z.zone_id WHERE z.hour IN (8, 14) AND inbound + outbound > 0

moment AS (SELECT TIMESTAMP '2024-01-31 00:00:00' AS t, TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 400 HOUR AS b),
mine AS (SELECT c.* FROM cycle_states c, moment WHERE started_at BETWEEN b AND t),
seen AS (SELECT s.* FROM snapshots s JOIN hotspots h ON h.hotspot_id = s.hotspot_id AND h.is_polled, moment WHERE fetched_at BETWEEN b AND t),
spaces AS (
  SELECT 'between_cycles' AS kind, since, started_at AS until FROM (SELECT started_at, lag(started_at) OVER (ORDER BY started_at, cycle_id) AS since FROM mine) l WHERE since IS NOT NULL
  UNION ALL SELECT 'window_head', b, min(started_at) FROM mine, moment GROUP BY b HAVING count(*) > 0
  UNION ALL SELECT 'window_tail', max(started_at), t FROM mine, moment GROUP BY t HAVING count(*) > 0
  UNION ALL SELECT 'empty_window', b, t FROM moment WHERE NOT EXISTS (SELECT 1 FROM mine)),
spans AS (SELECT *, greatest(0, (epoch_us(until) - epoch_us(since)) / CAST(60000000 AS DOUBLE)) AS gap_min FROM spaces),
gaps AS (SELECT *, CAST(greatest(0, floor(gap_min / 45 + 0.5) - 1) AS BIGINT) AS missed FROM spans WHERE gap_min >= 67.5),
placed AS (
  SELECT s.event_id, c.cycle_id, row_number() OVER (PARTITION BY s.event_id ORDER BY c.started_at DESC, c.cycle_id DESC) AS rn
  FROM seen s JOIN mine c ON s.fetched_at >= c.started_at AND s.fetched_at <= coalesce(c.completed_at, TIMESTAMP '2024-01-31 00:00:00')),
told AS (
  SELECT m.*, coalesce(n, 0) AS new_snapshots, CASE WHEN coalesce(n, 0) > 0 THEN 'new_data' WHEN status = 'complete' THEN 'duplicate_or_unchanged' WHEN status = 'running' THEN 'pending' ELSE 'no_new_data_failure' END AS signal
  FROM mine m LEFT JOIN (SELECT cycle_id, count(*) AS n FROM placed WHERE rn = 1 GROUP BY cycle_id) p ON p.cycle_id = m.cycle_id)

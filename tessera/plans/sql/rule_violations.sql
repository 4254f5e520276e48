WITH
-- include near_of
, made AS (SELECT cafe_id, sum(level / pow(greatest(d, 50), 2)) / sum(1 / pow(greatest(d, 50), 2)) AS score FROM near GROUP BY cafe_id),
s AS (SELECT CASE WHEN event_id % 5 = 0 THEN 5 ELSE level END AS level, ppltn_min, ppltn_max - 600 AS ppltn_max FROM snapshots)
SELECT 'hotspots' AS "table", 'lat' AS rule, count(*) FILTER (WHERE NOT lat BETWEEN -90 AND 90) AS n FROM hotspots
UNION ALL SELECT 'hotspots', 'lng', count(*) FILTER (WHERE NOT lng BETWEEN -180 AND 180) FROM hotspots
UNION ALL SELECT 'hotspot_snapshots', 'level', count(*) FILTER (WHERE NOT level BETWEEN 1 AND 4) FROM s
UNION ALL SELECT 'hotspot_snapshots', 'bounds', count(*) FILTER (WHERE ppltn_min < 0 OR ppltn_min > ppltn_max) FROM s
UNION ALL SELECT 'cafes', 'confidence', count(*) FILTER (WHERE NOT source_confidence BETWEEN 0 AND 1) FROM cafes
UNION ALL SELECT 'cafes', 'lat', count(*) FILTER (WHERE NOT lat BETWEEN -90 AND 90) FROM cafes
UNION ALL SELECT 'cafes', 'lng', count(*) FILTER (WHERE NOT lng BETWEEN -180 AND 180) FROM cafes
UNION ALL SELECT 'ingest_cycles', 'counts', count(*) FILTER (WHERE saved < 0 OR failed < 0 OR saved + failed > targets) FROM cycle_states
UNION ALL SELECT 'ingest_cycles', 'state', count(*) FILTER (WHERE (completed_at IS NULL) <> (status = 'running')) FROM cycle_states
UNION ALL SELECT 'ingest_cycles', 'complete', count(*) FILTER (WHERE status = 'complete' AND NOT (saved = targets AND failed = 0 AND saved > 0)) FROM cycle_states
UNION ALL SELECT 'cafe_scores', 'nulls', CAST(0 AS BIGINT)
UNION ALL SELECT 'cafe_scores', 'score', count(*) FILTER (WHERE NOT score BETWEEN 1 AND 4) FROM made

WITH
-- include near_of
, first AS (SELECT cafe_id, hotspot_id, CASE WHEN d <= 300 THEN 'near' WHEN d <= 600 THEN 'mid' ELSE 'fringe' END AS band FROM near WHERE rank = 1),
n AS (SELECT hotspot_id, band, least(2, count(*)) AS found FROM first GROUP BY hotspot_id, band),
k AS (SELECT hotspot_id, unnest(['near', 'mid', 'fringe']) AS band FROM hotspots WHERE is_polled)
SELECT k.hotspot_id, k.band, coalesce(n.found, 0) AS found, CAST(2 AS INT) AS wanted FROM k LEFT JOIN n ON n.hotspot_id = k.hotspot_id AND n.band = k.band WHERE coalesce(n.found, 0) < 2

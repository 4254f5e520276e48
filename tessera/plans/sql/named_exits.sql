WITH RECURSIVE
-- include stations_of
, numbered AS (
  SELECT exit_id, lat, lng, regexp_replace(lower(regexp_replace(label, '\s', '', 'g')), '역$', '') AS label,
    CASE WHEN regexp_full_match(ref, '[0-9]{1,2}(-[0-9]{1,2})?') THEN ref
      ELSE nullif(regexp_extract(label, '([0-9]{1,2}(?:-[0-9]{1,2})?)\s*번?\s*(?:출구|출입구)', 1), '') END AS exit_no
  FROM transit_exits),
near AS (
  SELECT e.exit_id, s.station_id, s.name, 12742000 * asin(sqrt(least(CAST(1 AS DOUBLE), pow(sin(radians(s.lat - e.lat) / 2), 2)
    + cos(radians(e.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - e.lng) / 2), 2)))) AS d
  FROM numbered e JOIN stations s ON contains(e.label, regexp_replace(lower(regexp_replace(s.name, '\s', '', 'g')), '역$', '')) WHERE e.exit_no IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY exit_id ORDER BY d, station_id) AS place FROM near WHERE d <= 700),
joined AS (
  SELECT e.exit_id, e.exit_no, e.lat, e.lng, b.station_id, b.name AS station_name, CASE WHEN b.station_id IS NULL THEN e.exit_id END AS own
  FROM numbered e LEFT JOIN best b ON b.exit_id = e.exit_id AND b.place = 1 WHERE e.exit_no IS NOT NULL)
SELECT min(exit_id) AS exit_id, exit_no, station_id, station_name FROM joined GROUP BY station_id, station_name, exit_no, lat, lng, own

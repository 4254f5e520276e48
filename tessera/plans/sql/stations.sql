WITH RECURSIVE
-- include stations_of
SELECT station_id, name, stops, lines, CAST(10 - least(9, n_lines) AS INT) AS label_priority, lat, lng FROM stations

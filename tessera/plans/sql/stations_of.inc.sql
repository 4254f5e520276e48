keyed AS (
  SELECT *, regexp_replace(lower(regexp_replace(name, '\s', '', 'g')), '역$', '') AS key FROM transit_stops),
linked AS (
  SELECT a.stop_id AS u, b.stop_id AS v FROM keyed a JOIN keyed b ON a.key = b.key
  WHERE 12742000 * asin(sqrt(least(CAST(1 AS DOUBLE), pow(sin(radians(b.lat - a.lat) / 2), 2)
    + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) <= 350),
reached AS (
  SELECT u AS stop_id, u AS seen FROM linked UNION SELECT reached.stop_id, linked.v FROM reached JOIN linked ON linked.u = reached.seen),
homes AS (SELECT stop_id, min(seen) AS station_id FROM reached GROUP BY stop_id),
named AS (
  SELECT station_id, name, row_number() OVER (PARTITION BY station_id ORDER BY count(*) DESC, length(name), name) AS place
  FROM homes JOIN keyed USING (stop_id) GROUP BY station_id, name),
stations AS (
  SELECT h.station_id, max(n.name) AS name, count(*) AS stops, string_agg(DISTINCT k.line, ',' ORDER BY k.line) AS lines, count(DISTINCT k.line) AS n_lines,
    round(avg(k.lat), 6) AS lat, round(avg(k.lng), 6) AS lng
  FROM homes h JOIN keyed k USING (stop_id) JOIN named n ON n.station_id = h.station_id AND n.place = 1 GROUP BY h.station_id)

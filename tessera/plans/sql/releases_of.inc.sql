old AS (SELECT * FROM catalogue_a WHERE place_id % 9 <> 4),
new AS (SELECT place_id - 1000000 AS place_id, norm_name, phone, lat FROM catalogue_b WHERE place_id < 2000000),
j AS (
  SELECT o.place_id, o.norm_name <> n.norm_name AS a, o.phone IS DISTINCT FROM n.phone AS b, abs(o.lat - n.lat) > 1e-12 AS c, abs(o.lat - n.lat) * CAST(111320 AS DOUBLE) AS moved FROM old o JOIN new n ON n.place_id = o.place_id)

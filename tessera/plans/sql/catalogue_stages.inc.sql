first AS (SELECT * FROM catalogue_a WHERE place_id % 2 = 0),
permits AS (SELECT * FROM catalogue_a WHERE place_id % 2 = 1),
m1 AS (
  SELECT *, count(*) OVER (PARTITION BY p_id) AS np, count(*) OVER (PARTITION BY f_id) AS nf FROM (
    SELECT k.place_id AS p_id, f.place_id AS f_id, k.norm_name = f.norm_name AND d <= 50 AS nm, coalesce(k.phone = f.phone AND d <= 150, false) AS ph, d FROM (
      SELECT k AS k, f AS f, 2 * 6371008.8 * asin(sqrt(least(CAST(1 AS DOUBLE), pow(sin(radians(f.lat - k.lat) / 2), 2) + cos(radians(k.lat)) * cos(radians(f.lat)) * pow(sin(radians(f.lng - k.lng) / 2), 2)))) AS d
      FROM catalogue_b k JOIN first f ON abs(k.lat - f.lat) < 0.0015 AND abs(k.lng - f.lng) < 0.0019) x) y WHERE nm OR ph),
rest AS (SELECT * FROM catalogue_b WHERE place_id NOT IN (SELECT p_id FROM m1)),
m2 AS (
  SELECT *, count(*) OVER (PARTITION BY p_id) AS np, count(*) OVER (PARTITION BY f_id) AS nf FROM (
    SELECT k.place_id AS p_id, f.place_id AS f_id, k.norm_name = f.norm_name AND d <= 50 AS nm, coalesce(k.phone = f.phone AND d <= 150, false) AS ph, d FROM (
      SELECT k AS k, f AS f, 2 * 6371008.8 * asin(sqrt(least(CAST(1 AS DOUBLE), pow(sin(radians(f.lat - k.lat) / 2), 2) + cos(radians(k.lat)) * cos(radians(f.lat)) * pow(sin(radians(f.lng - k.lng) / 2), 2)))) AS d
      FROM rest k JOIN permits f ON abs(k.lat - f.lat) < 0.0015 AND abs(k.lng - f.lng) < 0.0019) x) y WHERE nm OR ph),
remaining AS (SELECT * FROM rest WHERE place_id NOT IN (SELECT p_id FROM m2 WHERE np = 1 AND nf = 1)),
m3 AS (
  SELECT *, count(*) OVER (PARTITION BY p_id) AS np, count(*) OVER (PARTITION BY f_id) AS nf FROM (
    SELECT k.place_id AS p_id, f.place_id AS f_id FROM remaining k JOIN first f ON k.norm_name = f.norm_name AND k.phone = f.phone WHERE f.place_id NOT IN (SELECT f_id FROM m1 WHERE np = 1 AND nf = 1)) x)

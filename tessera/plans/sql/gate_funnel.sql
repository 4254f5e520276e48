WITH
p AS (SELECT *, radians(lat) AS a, radians(lng) AS o, lower(regexp_replace(name, '\s+', ' ', 'g')) AS nm, regexp_replace(phone, '[^0-9]', '', 'g') AS ph FROM permit_places),
c AS (
  SELECT *, radians(lat) AS a, radians(lng) AS o, lower(regexp_replace(name, '\s+', ' ', 'g')) AS nm, CASE WHEN regexp_full_match(phone, '[0-9+().\s-]+') THEN regexp_replace(phone, '[^0-9]', '', 'g') END AS ph
  FROM cafe_places WHERE origin_provider <> 'permit'),
cubes AS (
  SELECT p.permit_id, p.nm = c.nm AS nm, p.address = c.address AS ad, c.placed AND p.building = c.building AND (p.k % 4 = 0) = (c.k % 4 = 0) AS st, coalesce(p.ph = c.ph, false) AS ph,
    2 * 6371008.8 * asin(sqrt(least(CAST(1 AS DOUBLE), pow(sin((c.a - p.a) / 2), 2) + cos(p.a) * cos(c.a) * pow(sin((c.o - p.o) / 2), 2)))) <= 50 AS near
  FROM p JOIN c ON abs(floor(6371008.8 * cos(p.a) * cos(p.o) / 50) - floor(6371008.8 * cos(c.a) * cos(c.o) / 50)) <= 1
    AND abs(floor(6371008.8 * cos(p.a) * sin(p.o) / 50) - floor(6371008.8 * cos(c.a) * sin(c.o) / 50)) <= 1 AND abs(floor(6371008.8 * sin(p.a) / 50) - floor(6371008.8 * sin(c.a) / 50)) <= 1),
gates AS (
  SELECT permit_id, unnest([true, near, near AND nm, near AND ad, near AND st, near AND ph, near AND ad AND nm, near AND ad AND ph, near AND nm AND ph, near AND st AND nm, near AND st AND ph]) AS ok, unnest(range(0, 11)) AS stage FROM cubes),
names AS (
  SELECT unnest(range(0, 11)) AS stage, unnest(['grid_nearby', 'actual_within_distance_gate', 'exact_normalized_name_within_distance_gate', 'exact_normalized_address_within_distance_gate',
    'exact_structured_address_within_distance_gate', 'exact_normalized_phone_within_distance_gate', 'exact_normalized_address_and_name_within_distance_gate', 'exact_normalized_address_and_phone_within_distance_gate',
    'exact_name_and_phone_within_distance_gate', 'exact_structured_address_and_name_within_distance_gate', 'exact_structured_address_and_phone_within_distance_gate']) AS gate)
SELECT CAST(n.stage AS INT) AS stage, gate, count(*) FILTER (WHERE ok) AS pairs, count(DISTINCT permit_id) FILTER (WHERE ok) AS permits FROM names n LEFT JOIN gates g ON g.stage = n.stage GROUP BY n.stage, gate
